"""Segmentation: sentences, length-bounded chunks, semantic breaks.

Each packer is here twice: as a plain function of one text, which says what it does, and as a
column of built-in functions. A column's packer folds over the pieces of a text; what is held
and the lines that are done are the state, and nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lines as L
from textloom.functions import text as X

# What ends a sentence, and where a long one without commas is cut, in this order.
ENDS = "。！？"
COMMA = "、"
CUTS = ("が、", "けれど", "しかし", "また、", "そして", "ので", "から")
AFTER_PARTICLE = "(は、|が、|を、|に、|で、|と、|から、|まで、|より、)"
AFTER_MODIFIER = "(という|といった|などの|ような|ために)"
AFTER_POLITE = "(であり、|であって、|ですが、|ですけれど、)"
LONG_CLAUSE = re.compile("、[^\n]{20,}?、")


def sentences(text: str) -> list[str]:
    """Pieces of a text, each with the mark that ends it, and what is behind the last mark, maybe nothing."""
    *full, rest = re.split(f"(?<=[{ENDS}])", text)
    return [*full, rest]


def pack(pieces: list[str], limit: int) -> Iterator[str]:
    """Pieces joined while their length stays within ``limit``; a longer piece stands alone."""
    held = ""
    for piece in pieces:
        if len(held) + len(piece) <= limit:
            held += piece
        else:
            if held:
                yield held
            held = piece
    if held:
        yield held


def comma_pieces(text: str) -> list[str]:
    return [p for p in re.split(f"(?<={COMMA})", text)]


def punctuation_lines(text: str, limit: int) -> str:
    """X6. A line for each sentence; longer ones are packed by commas or cut behind a conjunction.

    What is behind such a cut is carried into the next sentence. Behind the last mark is one more
    piece, empty where the text ends in a mark, with which a carried remainder is cut once more.
    Lines over 30 characters that end in a full stop are followed by an empty line. Linear: marks
    are sought from where they were found last.
    """
    out: list[str] = []
    #: What is held is text[start:end]. A sought place is looked for again only when the start has passed it.
    start = end = 0
    places = dict.fromkeys((COMMA, *CUTS), -1)

    def place(mark: str) -> int:
        """Where ``mark`` lies in what is held, or -1."""
        if places[mark] < start:
            at = text.find(mark, start)
            places[mark] = len(text) if at < 0 else at
        return places[mark] if places[mark] + len(mark) <= end else -1

    for piece in sentences(text):
        end += len(piece)
        if end - start > limit:
            if place(COMMA) >= 0:
                out += pack(comma_pieces(text[start:end]), limit)
                start = end
            else:
                cut = next((c for c in CUTS if place(c) >= 0), None)
                behind = end if cut is None else place(cut) + len(cut)
                out.append(text[start:behind])
                start = behind
        elif end > start and text[end - 1] in ENDS:
            out.append(text[start:end])
            start = end
    out.append(text[start:end])
    full = [s for s in (x.strip() for x in out) if s]
    return "\n".join(y for x in full for y in ((x, "") if x.endswith("。") and len(x) > 30 else (x,)))


def natural_chunks(text: str, limit: int = 150, least: int = 20) -> list[str]:
    """X11. Sentences; those over ``limit`` packed by commas; short ones appended where they fit."""
    full = [s for s in (x.strip() for x in sentences(text)) if s]
    cut = [p for s in full for p in ([s] if len(s) <= limit else pack(comma_pieces(s), limit))]
    out: list[str] = []
    for piece in cut:
        if out and len(piece) < least and len(out[-1]) + len(piece) <= limit:
            out[-1] += piece
        else:
            out.append(piece)
    return out


def bounded_chunks(text: str, limit: int = 200, hard_limit: int | None = None) -> list[str]:
    """X12. A text within ``limit`` as it is; else its sentences, each re-ended with 。, packed.

    A sentence over the limit stays whole, unless ``hard_limit`` cuts it.
    """
    if len(text) <= limit:
        return [text]
    pieces = [s + "。" for s in re.split(f"[{ENDS}\n]", text) if s.strip()]
    out = list(pack(pieces, limit))
    if hard_limit:
        out = [c[k : k + hard_limit] for c in out for k in range(0, len(c), hard_limit)]
    return out


def break_long_clauses(text: str) -> str:
    """X8, fourth rule: a newline behind both commas of a clause of 20 characters or more."""
    return LONG_CLAUSE.sub(lambda m: m[0].replace(COMMA, COMMA + "\n"), text)


#: Lines that a fold gathers before it lays them aside; so it copies a bounded number for each piece.
GATHERED = 32


def _fold(pieces: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Lines of a fold over pieces: ``step(held, piece)`` is a struct of lines that are done, and of what is held.

    What is held at the end is the last line. Built in, and linear but for what is held: lines
    are gathered in parts of GATHERED.
    """
    none = F.array().cast("array<string>")

    def add(state: Column, piece: Column) -> Column:
        # the lines of a step join the others in the next one: a function would copy what it is given
        part = F.concat(state["part"], state["last"]["done"])
        whole = F.size(state["part"]) + F.size(state["last"]["done"]) >= GATHERED
        full = F.when(whole, F.concat(state["full"], F.array(part))).otherwise(state["full"])
        return F.struct(step(state["last"]["held"], piece).alias("last"), F.when(whole, none).otherwise(part).alias("part"), full.alias("full"))

    start = F.struct(_state(none, F.lit("")).alias("last"), none.alias("part"), F.array().cast("array<array<string>>").alias("full"))
    return F.aggregate(pieces, start, add, lambda s: F.concat(F.flatten(s["full"]), s["part"], s["last"]["done"], F.array(s["last"]["held"])))


def _state(done: Column, held: Column) -> Column:
    return F.struct(done.alias("done"), held.alias("held"))


def _sentences(text: Column) -> Column:
    """:func:`sentences` of a column, by searches of bytes and of one sign; a text that has the sign is split by the rule."""
    sign = "\0"

    def parts(t: Column) -> Column:
        marked = t
        for mark in ENDS:
            marked = F.replace(marked, F.lit(mark), F.lit(mark + sign))
        return F.when(F.contains(t, F.lit(sign)), F.split(t, f"(?<=[{ENDS}])", -1)).otherwise(F.split(marked, sign, -1))

    return X.let(text, parts)


def _by_commas(text: Column, limit: int) -> Column:
    """:func:`pack` of the pieces by commas of a sentence: from each place as much as fits and ends in a comma or the text, else all to the next comma, or the rest."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{limit - 1}}}(?:{COMMA}|.\z)|[^{COMMA}]*{COMMA}|[^{COMMA}]+"), F.lit(0))


def split_punctuation(c: str | Column, limit: int = 50) -> Column:
    """X6 of a column, as :func:`punctuation_lines` has it; null stays null.

    Only where a cut carries a remainder into the next sentence are the sentences folded.
    """
    none = F.array().cast("array<string>")

    def step(held: Column, piece: Column) -> Column:
        def made(h: Column) -> Column:
            nothing = F.lit("")
            cut = F.coalesce(*(F.when(F.contains(h, F.lit(x)), F.locate(x, h) + len(x) - 1) for x in CUTS))
            behind = X.let(cut, lambda k: F.when(k.isNull(), _state(F.array(h), nothing)).otherwise(_state(F.array(F.substring(h, F.lit(1), k)), F.substring(h, k + 1, F.length(h)))))
            ended = F.substring(h, -1, 1).isin(*ENDS)
            return (
                F.when((F.length(h) > limit) & F.contains(h, F.lit(COMMA)), _state(_by_commas(h, limit), nothing))
                .when(F.length(h) > limit, behind)
                .when(ended, _state(F.array(h), nothing))
                .otherwise(_state(none, h))
            )

        return X.let(F.concat(held, piece), made)

    def spaced(x: Column) -> Column:
        return F.when(x.endswith("。") & (F.length(x) > 30), F.concat(x, F.lit("\n"))).when(x != "", x)

    def joined(lines: Column) -> Column:
        return F.array_join(F.transform(F.transform(lines, X.strip), spaced), "\n")  # nulls are left out

    def line(x: Column) -> Column:
        """Lines of a sentence that takes and leaves no remainder; pieces by commas are never blank."""
        return F.when((F.length(x) > limit) & F.contains(x, F.lit(COMMA)), joined(_by_commas(x, limit))).otherwise(X.let(X.strip(x), spaced))

    def carries(x: Column) -> Column:
        has = F.lit(False)
        for word in CUTS:
            has = has | F.contains(x, F.lit(word))
        return (F.length(x) > limit) & ~F.contains(x, F.lit(COMMA)) & has

    def lines(pieces: Column) -> Column:
        return F.when(F.exists(pieces, carries), joined(_fold(pieces, step))).otherwise(F.array_join(F.transform(pieces, line), "\n"))

    return X.let(_sentences(X.col(c)), lines)


def split_naturally(c: str | Column, limit: int = 150, least: int = 20) -> Column:
    """X11 of a column, as :func:`natural_chunks` has it: array of chunks; null stays null."""
    none = F.array().cast("array<string>")

    def step(held: Column, piece: Column) -> Column:
        joins = (held == "") | ((F.length(piece) < least) & (F.length(held) + F.length(piece) <= limit))
        return F.when(joins, _state(none, F.concat(held, piece))).otherwise(_state(F.array(held), piece))

    def joined(pieces: Column) -> Column:
        short = F.exists(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.length(x) < least)
        return F.when(short, F.filter(_fold(pieces, step), lambda x: x != "")).otherwise(pieces)

    full = F.filter(F.transform(_sentences(X.col(c)), X.strip), lambda x: x != "")
    cut = F.transform(full, lambda x: F.when(F.length(x) <= limit, F.array(x)).otherwise(_by_commas(x, limit)))
    return X.let(F.flatten(cut), joined)


def split_bounded(c: str | Column, limit: int = 200, hard_limit: int | None = None) -> Column:
    """X12 of a column, as :func:`bounded_chunks` has it: array of chunks; null stays null."""
    text = X.col(c)
    ended = text
    for mark in (*ENDS[1:], "\n"):
        ended = F.replace(ended, F.lit(mark), F.lit(ENDS[0]))
    pieces = F.transform(F.filter(F.split(ended, ENDS[0], -1), lambda x: ~X.is_blank(x)), lambda x: F.concat(x, F.lit("。")))
    # pieces end in the one full stop that they have: as many as fit, or a longer one alone
    out = F.regexp_extract_all(F.array_join(pieces, ""), F.lit(rf"(?s).{{0,{limit - 1}}}。|[^。]*。"), F.lit(0))
    if hard_limit:
        out = F.flatten(F.transform(out, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / hard_limit).cast("int")), lambda k: F.substring(x, k * hard_limit + 1, F.lit(hard_limit)))))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(out)


def semantic_breaks(c: str | Column) -> Column:
    """X8. Newlines behind particles, modifiers and polite endings, and in long clauses; then W9."""

    def broken(text: Column) -> Column:
        """Fourth rule, as :func:`break_long_clauses` has it: what lies between long clauses, and these with their breaks."""
        between, clauses = F.split(text, LONG_CLAUSE.pattern, -1), F.regexp_extract_all(text, F.lit(LONG_CLAUSE.pattern), F.lit(0))
        return F.array_join(F.zip_with(between, clauses, lambda x, y: F.concat(x, F.coalesce(F.replace(y, F.lit(COMMA), F.lit(COMMA + "\n")), F.lit("")))), "")

    text = X.let(X.chain(X.col(c), [(r, "$1\n") for r in (AFTER_PARTICLE, AFTER_MODIFIER, AFTER_POLITE)]), broken)
    return L.merge_short(F.split(F.regexp_replace(text, r"\n{3,}", "\n\n"), "\n"))


def hybrid(c: str | Column) -> Column:
    """X9. X4, X3, then X6 with 45 characters."""
    return split_punctuation(X.clean_text(X.remove_spaces(c)), 45)


#: X19. Methods by name; ``morphological`` has no analyser here and is its own fallback.
METHODS: dict[str, Callable[[Column], Column]] = {
    "punctuation": lambda c: split_punctuation(c, 50),
    "pauses": X.pause_tags,
    "morphological": lambda c: split_punctuation(c, 40),
    "semantic": semantic_breaks,
    "hybrid": hybrid,
    "clean": X.clean_only,
}


def format_text(c: str | Column, method: str = "hybrid") -> Column:
    """X19. P3 (rule of ten signs), X4, then the method; an unknown name is the hybrid."""
    return METHODS.get(method, hybrid)(X.remove_spaces(L.drop_preamble(c)))


def chunk_table(pages: DataFrame, chunks: Column, keys: tuple[str, ...] = ("corpus_id", "page_num")) -> DataFrame:
    """(keys, part_no, chunk): one row for each non-blank chunk, numbered from 1 (W10)."""
    out = pages.select(*keys, F.posexplode(chunks).alias("part_no", "chunk")).where(~X.is_blank("chunk"))
    return out.withColumn("part_no", F.col("part_no") + 1)
