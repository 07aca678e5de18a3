"""Byte-level BPE: encoding and decoding with a given vocabulary file.

Method: contiguous rank array. The parts of a short word and the ranks of its
adjacent pairs lie side by side in one array; the smallest rank is found by
scanning, its boundary is deleted and the two neighbouring ranks are refreshed.
Many words of one length class share the array, one in each line, so that a scan
is one numpy call. Words longer than ``SHORT`` bytes use a heap over linked parts,
which gives the same merges in n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._text import ranges, slices, strings

#: Bytes up to which a word goes to the rank array.
SHORT = 32
#: Distinct words whose ids a worker remembers; beyond it, it starts anew.
REMEMBERED = 600_000
_NEVER = np.int32(1 << 30)
#: White space as Unicode defines it; the chunks of a text end at it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file, given by its path or its bytes: merge ranks, token bytes and special tokens."""

    def __init__(self, source: str | bytes, pattern: str):
        import regex

        spec = json.loads(source if isinstance(source, bytes) else Path(source).read_bytes())
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        ids: dict[str, int] = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = 1 + max([*ids.values(), *special.values()])
        self.byte_id = np.array([ids[symbols[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.rank_of = {int(k): r for r, k in reversed(list(enumerate(key)))}
        self.made = made
        self._pair_table(key)
        token = [b""] * self.size
        for s, i in ids.items():
            token[i] = bytes(back[c] for c in s)
        for s, i in special.items():
            token[i] = s.encode()
        self.token_length = np.array([len(t) for t in token], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.special = special
        self.split = regex.compile(pattern)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.forget()

    def _pair_table(self, key: np.ndarray) -> None:
        """Hash table of the pairs that merge: rank by (left id, right id), open addressing."""
        bits = max(4, int(len(key)).bit_length() + 3)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NEVER, np.int32)
        todo, step = np.arange(len(key))[::-1], 0
        self.probes = 0
        seen, first = np.unique(key, return_index=True)
        todo = np.sort(first)
        while len(todo):
            slot = (self._slot(key[todo]) + step) & self.mask
            free = np.flatnonzero(self.slot_key[slot] == -1)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.slot_key[slot[put]], self.slot_rank[slot[put]] = key[todo[put]], todo[put]
            todo = np.delete(todo, put)
            step += 1
        self.probes = step

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def forget(self) -> None:
        self.index: dict[str, int] = {s: k for k, s in enumerate(self.special)}
        self.id_start = list(range(len(self.special)))
        self.id_count = [1] * len(self.special)
        self.ids = [np.array(list(self.special.values()), np.int64)]
        self.n_ids = len(self.special)
        self._flat = None

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, special tokens apart. No word of the pattern crosses a cut."""
        if self.special_split and any(s in text for s in self.special):
            return [w for k, part in enumerate(self.special_split.split(text)) if part for w in ([part] if k % 2 else _CHUNK.findall(part))]
        return _CHUNK.findall(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each adjacent pair, or _NEVER; a part of -1 merges with nothing."""
        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        found = self.slot_key[slot]
        out = np.where(found == key, self.slot_rank[slot], _NEVER)
        for step in range(1, self.probes):
            more = (found != key) & (found != -1)
            if not more.any():
                break
            at = np.nonzero(more)
            found = found.copy()
            slot = (self._slot(key[at]) + step) & self.mask
            found[at] = self.slot_key[slot]
            out[at] = np.where(found[at] == key[at], self.slot_rank[slot], _NEVER)
        out[(left < 0) | (right < 0)] = _NEVER
        return out

    def merge_lines(self, parts: np.ndarray) -> np.ndarray:
        """Rank arrays of many words at once. parts: one word in each line, -1 behind its end."""
        n, width = parts.shape
        done = parts.copy()
        if width == 1:
            return done
        p, live = parts, np.arange(n)
        r = np.full((n, width), _NEVER, np.int32)
        r[:, :-1] = self.rank(p[:, :-1], p[:, 1:])
        columns = np.arange(width)
        while len(live):
            line = np.arange(len(live))
            at = r.argmin(1)
            best = r[line, at]
            stop = best == _NEVER
            if stop.any():
                done[live[stop]] = p[stop]
                go = ~stop
                p, r, live, at, best = p[go], r[go], live[go], at[go], best[go]
                line = line[: len(live)]
                if not len(live):
                    break
            behind = columns > at[:, None]
            for x, end in ((p, -1), (r, _NEVER)):  # the boundary behind the merged part goes
                moved = np.full_like(x, end)
                moved[:, :-1] = x[:, 1:]
                np.copyto(x, moved, where=behind)
            merged = self.made[best].astype(np.int32)
            p[line, at] = merged
            right = np.where(at + 1 < width, p[line, np.minimum(at + 1, width - 1)], -1)
            r[line, at] = self.rank(merged, right)
            left = np.maximum(at - 1, 0)
            r[line, left] = np.where(at > 0, self.rank(p[line, left], merged), r[line, left])
        return done

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges for one long word: a heap of ranks over linked parts."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, part[k], part[k + 1]) for k in range(n - 1) if (r := self.rank_of.get(part[k] * self.size + part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k] if part[k] == a else n
            if j >= n or part[j] != b:
                continue
            part[k], part[j] = int(self.made[r]), -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := self.rank_of.get(part[x] * self.size + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p >= 0]

    def learn(self, unknown: list[str]) -> None:
        """Find the ids of chunks not met before, word by word."""
        inner = [self.split.findall(c) for c in unknown]
        n_inner = np.array([len(x) for x in inner], np.int64)
        raw = [w.encode("utf-8", "replace") for w in chain.from_iterable(inner)]
        length = np.array([len(w) for w in raw], np.int64)
        flat, start, count = [], np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        total = 0
        for low, high in ((1, 6), (7, 11), (12, 18), (19, SHORT)):
            pick = np.flatnonzero((length >= low) & (length <= high))
            for k in range(0, len(pick), 20_000):
                some = pick[k : k + 20_000]
                size = length[some]
                parts = np.full((len(some), high), -1, np.int32)
                parts[np.repeat(np.arange(len(some)), size), ranges(np.zeros(len(some), np.int64), size)] = self.byte_id[np.frombuffer(b"".join(raw[i] for i in some), np.uint8)]
                parts = self.merge_lines(parts)
                made = parts >= 0
                count[some] = made.sum(1)
                start[some] = total + np.cumsum(count[some]) - count[some]
                flat.append(parts[made].astype(np.int64))
                total += len(flat[-1])
        for i in np.flatnonzero(length > SHORT):
            flat.append(np.array(self.merge_long(raw[i]), np.int64))
            start[i], count[i] = total, len(flat[-1])
            total += len(flat[-1])
        ids = np.concatenate([*flat, np.zeros(0, np.int64)])[ranges(start, count)]
        before = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(n_inner)
        self._keep(unknown, ids, before[ends] - before[ends - n_inner])

    def _keep(self, new: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.index.update(zip(new, range(len(self.id_start), len(self.id_start) + len(new)), strict=True))
        self.id_start += (np.cumsum(count) - count + self.n_ids).tolist()
        self.id_count += count.tolist()
        self.ids.append(ids)
        self.n_ids += len(ids)
        self._flat = None

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in one array, and how many each text has."""
        if len(self.index) > REMEMBERED:
            self.forget()
        found = [self.chunks(t) for t in texts]
        if unknown := [w for w in set().union(*found) if w not in self.index]:
            self.learn(unknown)
        if self._flat is None:
            self._flat = np.array(self.id_start), np.array(self.id_count), np.concatenate(self.ids)
            self.ids = [self._flat[2]]
        start, count, flat = self._flat
        n_words = np.array([len(f) for f in found], np.int64)
        w = np.fromiter(map(self.index.__getitem__, chain.from_iterable(found)), np.int64, int(n_words.sum()))
        ids = flat[ranges(start[w], count[w])]
        before = np.concatenate([[0], np.cumsum(count[w])])
        ends = np.cumsum(n_words)
        return ids, before[ends] - before[ends - n_words]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in one array, and the bounds of each."""
        size = self.token_length[ids]
        data = self.token_bytes[ranges(self.token_start[ids], size)]
        before = np.concatenate([[0], np.cumsum(size)])
        return data, before[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=2)
def vocabulary(source: str | bytes, pattern: str) -> Vocabulary:
    return Vocabulary(source, pattern)


def valid(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts from bytes; malformed sequences, also those that two rows share, become U+FFFD, as a lossy decoder has it."""
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    try:
        if (data[inner] & 0xC0 == 0x80).any():
            raise UnicodeDecodeError("utf-8", b"", 0, 1, "a character over two rows")
        data.tobytes().decode("utf-8")
        return strings(data.tobytes(), bounds)
    except UnicodeDecodeError:
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())


def encode_decode(df: DataFrame, path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode each text and decode its ids: columns ``keep``, ids array<int>, decoded string.

    One row for each input row, repeated rows included; a null text counts as empty
    and has no ids. Texts are encoded whole, however long. Extra columns of the input
    are left out, whatever their names. Narrow: no shuffle.
    """
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    state = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a few MB; workers need no file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(state.value, pattern)
        for batch in batches:
            for rows in slices(batch.column(0)):
                ids, counts = v.encode([rows.text(k) for k in range(len(rows))])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                kept = [batch.column(k + 1).slice(rows.first, len(rows)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, lists, valid(*v.decode(ids, counts))], names=[*keep, "ids", "decoded"])

    return df.select(F.col(text).alias("__text"), *keep).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Decode arrays of ids: columns ``keep``, decoded string.

    A null array decodes to the empty text; null ids and ids that the vocabulary doesn't have,
    negative ones too, are left out. Bytes that are no character in their row, as where ids split
    one over two rows, become U+FFFD. One row for each input row, repeated ones included; other
    columns are left out, whatever their names.
    """
    schema = T.StructType([df.schema[k] for k in keep] + [T.StructField("decoded", T.StringType())])

    state = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())  # a few MB; workers need no file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(state.value, pattern)
        for batch in batches:
            lists = [[i for i in x or () if i is not None and 0 <= i < v.size] for x in batch.column(0).to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            flat = np.array([i for x in lists for i in x], np.int64)
            kept = [batch.column(k + 1) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, valid(*v.decode(flat, counts))], names=[*keep, "decoded"])

    return df.select(F.col(ids).alias("__ids"), *keep).mapInArrow(run, schema)
