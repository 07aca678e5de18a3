"""Secret scan: known shapes, and literals assigned to sensitive names.

Base shapes are regular expressions. The method adds an assignment-aware lexer:
it reads source, configuration and markup syntax into (name, literal) pairs, carries
constants from name to name, whatever their order, and scores every literal by the most
sensitive name it reaches.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm._text import slices

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Sensitivity of the words of a name, 0 to 1. Fixed values.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "cred": 0.7, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "api": 0.4,
    "key": 0.4, "signing": 0.4, "encryption": 0.4, "salt": 0.5, "cookie": 0.4, "session": 0.4, "client": 0.1, "dsn": 0.5,
}
#: Words that tell that a name holds no secret though it has a sensitive word. Fixed values.
HARMLESS = {"name", "id", "path", "file", "url", "uri", "length", "len", "size", "count", "type", "field", "header", "prefix", "expiry", "ttl", "timeout", "policy", "hint", "label", "public"}
#: Values that stand for a secret to be filled in. Fixed values.
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|your.*|change_?me.*|example.*|placeholder.*|dummy.*|test|none|null|true|false|undefined|redacted|<.*>|\$\{.*\}|%.*%|\{\{.*\}\})$")

_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_TOKENS = (
    r"(?P<word>[A-Za-z_$][A-Za-z0-9_$-]*(?:(?:\.|::|->)[A-Za-z_$][A-Za-z0-9_$-]*)*)"
    r"|(?P<bare>[0-9][A-Za-z0-9+/_.=-]*)"
    r"|(?P<op>:=|=>|[=!<>]=|[=:+,;(){}\[\]&|])"
    r"|(?P<line>\n)"
)
#: Body of a string that begins with a quote: to its end, or to where its line ends.
QUOTES = "\"'`"
_BODY = {q: rf"{q}[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+" for q in QUOTES}


def _lexer(quotes: str) -> re.Pattern[str]:
    """Tokens, with strings in some quotes; ``open`` is a string that its line does not end."""
    closed = "|".join(_BODY[q] + q for q in quotes)
    begun = "|".join(_BODY[q] for q in quotes)
    return re.compile((f"(?P<string>{closed})|(?P<open>{begun})|" if quotes else "") + _TOKENS)


#: By the quotes that may begin a string.
_LEX = {quotes: _lexer("".join(quotes)) for n in range(4) for quotes in combinations(QUOTES, n)}
_BARE = re.compile(r"[^\s\"'`,;#&(){}\[\]]+")
#: A string over several lines, and a block value: its mark, and what may follow on the line.
_TRIPLE = ('"""', "'''")
_BLOCK = re.compile(r"[|>][+-]?[1-9]?[+-]?[ \t]*(?:#[^\n]*)?\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
_ANCHOR = re.compile(r"&([A-Za-z0-9_-]+)[ \t]+")
_INSERTED = re.compile(r"\{\{?\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}?\}|\$([A-Za-z_][A-Za-z0-9_]*)")
_ELEMENT = re.compile(r"<([A-Za-z][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>\s*+([^<>\s][^<>]*)</\1\s*>")
_ATTRIBUTES = re.compile(r"\b(?:key|name)\s*=\s*\"([^\"<>\n]+)\"\s+value\s*=\s*\"([^\"<>\n]+)\"")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*")
#: What a text with an assignment has somewhere.
_SHAPED = re.compile(r"[:=]|\(\s*[\"'`]|</")
#: Names below this score are not sensitive.
SENSITIVE_NAME = 0.4
#: A literal is reported from this score on.
THRESHOLD = 0.6


def name_score(name: str) -> float:
    """How sensitive a target name is: the strongest word or pair of words, less harmless ones."""
    parts = [p.lower() for p in _NAME_PART.findall(name)]
    if not parts:
        return 0.0
    scores = sorted((SENSITIVE.get(p, 0.0) for p in parts), reverse=True)
    if (joined := "".join(parts)) in SENSITIVE:
        scores.insert(0, SENSITIVE[joined])
    score = min(1.0, scores[0] + 0.6 * sum(scores[1:2]))
    return score * 0.3 if parts[-1] in HARMLESS else score


def value_score(value: str) -> float:
    """How much a literal looks like key material: length, mixture of characters, entropy."""
    value = _INSERTED.sub("", value)  # what is inserted is scored where it comes from
    n = len(value)
    if n < 8 or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return min(1.0, 0.25 * (kinds - 1) + entropy / 6)


Pieces = list[tuple[str, int, int]]


def assignments(text: str) -> Iterator[tuple[str, Pieces, Pieces]]:
    """(name, literals, referenced names) of each assignment, in order, both as (value, start, end).

    Understood: ``name = "x"``, ``name: type = "x"``, ``name: x``, ``"name": "x"``,
    ``name := x``, ``name => x``, ``export NAME=x``, ``table["name"] = "x"``,
    ``call("name", "x")``, ``name: &anchor x`` and ``name: *anchor``, literals joined by + or
    side by side, names on the right or inserted in a string (``{name}``, ``$name``), three
    kinds of quotes, strings in three quotes over several lines, and indented blocks behind
    ``name: |`` and ``name: >``, of both each line for itself. Quoted literals and keys may have
    any length; another string ends on its line. Linear: what is read ahead is not read again.
    """
    at, n = 0, len(text)
    target: str | None = None
    by = ""  # the operator that made the target
    anchor: str | None = None
    last: str | None = None  # a name or quoted key that an operator may follow
    first: tuple[str, int, int] | None = None  # a string right behind an open parenthesis
    opened = False
    literals: Pieces = []
    refs: Pieces = []
    # a quote that its line does not close: no quote of its kind before there begins a string either
    dead = dict.fromkeys(QUOTES, 0)
    unclosed: set[str] = set()  # three quotes that nothing closes from here on
    bare_end = 0  # where the bare value ends that was read last

    def lines(start: int, end: int) -> Pieces:
        return [(m[2].rstrip(), m.start(2), m.start(2) + len(m[2].rstrip())) for m in _LINE.finditer(text, start, end) if m[2].strip()]

    def done() -> Iterator[tuple[str, Pieces, Pieces]]:
        if target is not None and (literals or refs):
            yield target, literals, refs
            if anchor is not None:
                yield anchor, literals, refs

    while at < n:
        live = tuple(q for q in QUOTES if at >= dead[q])
        stop = n if len(live) == len(QUOTES) else min(end for end in dead.values() if end > at)
        lex = _LEX[live]
        m = lex.match(text, at, stop) or lex.search(text, at + 1, stop)
        if m is None:
            at = stop
            continue
        kind, got, at = m.lastgroup, m[0], m.end()
        if kind in ("string", "open") and (three := text[m.start() : m.start() + 3]) in _TRIPLE and three not in unclosed:
            end = text.find(three, m.start() + 3)
            if end >= 0:
                if target is not None:
                    literals += lines(m.start() + 3, end)
                at, last, first, opened = end + 3, None, None, False
                continue
            unclosed.add(three)
        if kind == "open":
            dead[got[0]], at = at, m.start()
            continue
        argument, opened = opened, got == "("
        if kind == "op" and got in ("=", ":", ":=", "=>") and last is not None:
            if refs and refs[-1][0] == last:
                refs.pop()
            elif literals and literals[-1][0] == last:
                literals.pop()
            typed = got == "=" and by == ":" and target is not None and not literals and not refs and text[m.start() - 1] == " "
            if not typed:  # ``name: type = x`` keeps its name
                yield from done()
                target, by, anchor = last, got, None
            last, first, literals, refs = None, None, [], []
            # an unquoted configuration value runs to white space
            p = at
            while p < n and text[p] == " ":
                p += 1
            if a := _ANCHOR.match(text, p):
                anchor, p = a[1], a.end()
                at = p
            if got == ":" and p < n and text[p] in "|>" and (block := _BLOCK.match(text, p)):
                begin = text.rfind("\n", 0, m.start()) + 1
                indent = _LINE.match(text, begin).end(1) - begin
                end = block.end()
                while (line := _LINE.match(text, end)) and line.end() > end and (not line[2].strip() or line.end(1) - end > indent):
                    end = line.end()
                literals += lines(block.end(), end)
                at = end
                yield from done()
                target, literals, refs, by, anchor = None, [], [], "", None
                continue
            if p >= bare_end:
                bare = _BARE.match(text, p)
                bare_end = bare.end() if bare else p
            behind, head = text[bare_end : bare_end + 1], text[p : p + 1]
            if bare_end <= p or behind in ("(", '"', "'", "`") and head != "*" or head in "<>=!":
                continue
            value = text[p:bare_end]
            if head == "*" and len(value) > 1:
                refs.append((value[1:], p + 1, bare_end))
                at = bare_end
            elif behind not in ("(", '"', "'", "`") and not _IDENTIFIER.fullmatch(value):
                literals.append((value, p, bare_end))
                refs += [(x[1] or x[2], p, p) for x in _INSERTED.finditer(value)]
                at = bare_end
        elif kind == "string":
            last = got[1:-1]
            if argument:
                first = last, m.start() + 1, m.end() - 1
            if target is not None:
                literals.append((last, m.start() + 1, m.end() - 1))
                refs += [(x[1] or x[2], m.start(), m.start()) for x in _INSERTED.finditer(last)]
        elif kind in ("word", "bare"):
            first = None
            if target is not None and text[at : at + 1] != "(":
                refs.append((got, m.start(), at))
            last = got if kind == "word" else None
        elif got == "," and first is not None and _IDENTIFIER.fullmatch(first[0]):
            # the first argument names the next ones; what the call is assigned to reaches them by that name
            if target is not None:
                literals = [x for x in literals if x != first]
                refs.append(first)
                yield from done()
            target, by, anchor, last, literals, refs, first = first[0], ",", None, None, [], [], None
        elif kind == "line" or got in (";", ",", "}", "{", ")"):
            first = None
            if target is not None and (literals or refs):
                yield from done()
                target, literals, refs = None, [], []
            elif kind != "line":
                target = None
            if target is None:
                last, by, anchor = None, "", None
        elif got not in ("+", "]"):
            last = None
    yield from done()


def marked_up(text: str) -> Iterator[tuple[str, Pieces, Pieces]]:
    """Assignments of markup: ``<name>x</name>``, ``key="name" value="x"``."""
    for pattern in (_ELEMENT, _ATTRIBUTES) if "<" in text else ():
        for m in pattern.finditer(text):
            value = m[2].rstrip()
            yield m[1], [(value, m.start(2), m.start(2) + len(value))], []


def sensitive_literals(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, by start.

    Names and the names they refer to make a graph, whatever the order of the lines. The
    score of a sensitive name goes to all names it refers to, from the highest score down,
    so each name is visited once and the work is linear in the text.
    """
    if not _SHAPED.search(text):
        return []
    own: dict[str, Pieces] = defaultdict(list)
    to: dict[str, Pieces] = defaultdict(list)
    alone: list[tuple[str, tuple[str, int, int]]] = []
    for name, literals, refs in (*assignments(text), *marked_up(text)):
        own[name] += literals
        to[name] += refs
        if len(refs) == 1 and not literals:
            alone.append((name, refs[0]))
    for name, ref in alone:  # an unknown word with digits is a bare value
        if ref[0] not in own and any(c.isdigit() for c in ref[0]):
            own[name].append(ref)
    reached: dict[str, float] = {}
    scores = {name: s for name in own if (s := name_score(name)) >= SENSITIVE_NAME}
    for name in sorted(scores, key=scores.__getitem__, reverse=True):
        todo = [name]
        while todo:
            at = todo.pop()
            if at in reached:
                continue
            reached[at] = scores[name]
            for ref, _, _ in to.get(at, ()):
                known = ref if ref in own else ref.rsplit(".", 1)[-1]
                if known in own and known not in reached:
                    todo.append(known)
    best: dict[tuple[int, int], float] = {}
    for name, s in reached.items():
        for value, a, b in own[name]:
            if (a, b) not in best or best[a, b] < s:
                best[a, b] = s
    for m in _ATTRIBUTES.finditer(text) if "<" in text else ():
        best.pop(m.span(1), None)  # the name of a pair, not what ``key=`` is assigned
    return sorted(k for k, s in best.items() if (v := value_score(text[k[0] : k[1]])) and 0.5 * s + 0.5 * v >= threshold)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base shapes, by start, then kind as listed."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda x: (x[0], x[2]))]


def scan_text(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as listed; code points, end exclusive."""
    found = base_spans(text) + [(a, b, "literal") for a, b in sensitive_literals(text, threshold)]
    return [(k, a, b) for a, b, k in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD, redact: bool = False, mark: str = "[SECRET]") -> DataFrame:
    """Columns ``keep`` and ``spans``: the secrets of each whole text, as (kind, start, end).

    One row for each input row. A null or empty text has no spans. With ``redact`` a
    column ``redacted`` follows: the text with each span, overlapping ones joined,
    replaced by ``mark`` (null for a null text). Other columns are left out, whatever
    their names. Narrow: no shuffle.
    """
    fields = [df.schema[k] for k in keep] + [T.StructField("spans", SPANS)]
    names = [*keep, "spans"]
    if redact:
        fields.append(T.StructField("redacted", T.StringType()))
        names.append("redacted")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            for rows in slices(column):
                texts = [rows.text(k) for k in range(len(rows))]
                spans = [scan_text(t, threshold) for t in texts]
                out = [kept.slice(rows.first, len(rows)) for kept in batch.column(1).flatten()]
                out.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], arrow))
                if redact:
                    null = column.slice(rows.first, len(rows)).is_null().to_pylist()
                    out.append(pa.array([None if x else replaced(t, s, mark) for x, t, s in zip(null, texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    # the kept columns travel as one struct, so no name can clash
    return df.select(F.col(text).alias("text"), F.struct(*(F.col(f"`{k}`") for k in keep)).alias("kept")).mapInArrow(run, T.StructType(fields))


def replaced(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with its spans replaced; overlapping or touching spans become one mark."""
    out, at = [], 0
    for k, (_, a, b) in enumerate(spans):
        if a >= at or k == 0:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text
