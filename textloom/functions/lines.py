"""Page lines as arrays: splitting, head and tail, predicates. No row leaves its page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import SPACE, col, is_blank, let, strip

# Titles and page numbers as the cleaners know them, on stripped lines (D: any digit).
D = r"\p{Nd}"
S = SPACE
CHAPTERS = (
    rf"第[一二三四五六七八九十\p{{Nd}}]+章",
    rf"第[一二三四五六七八九十\p{{Nd}}]+節",
    rf"第[一二三四五六七八九十\p{{Nd}}]+部",
    rf"{D}+\.{D}+",
    rf"{D}+章",
    rf"{D}+節",
    rf"Chapter{S}+{D}+",
    rf"Section{S}+{D}+",
    rf"Part{S}+{D}+",
)
PAGE_NUMBERS = (
    rf"{S}*[-‐]{S}*{D}+{S}*[-‐]{S}*\z",
    rf"{S}*\[{S}*{D}+{S}*\]{S}*\z",
    rf"{S}*\({S}*{D}+{S}*\){S}*\z",
    rf"P\.{S}*{D}+",
    rf"p\.{S}*{D}+",
    rf"{D}+{S}*ページ",
    rf"ページ{S}*{D}+",
)
DIGITS = rf"{S}*{D}+{S}*\z"
TITLE_WORDS = "章|節|部|Chapter|Section|Part"
SIDEBAR_WORDS = "第|章|節|部|Chapter|Section|Part|編|項|条|款|号"
NEAR_BLANK_WORDS = "第|章|Chapter|Section|節"
PREAMBLE = ("PDFファイル:", "ページ番号:", "=" * 10)


def anchored(*patterns: str) -> str:
    return "^(?:" + "|".join(patterns) + ")"


def split_lines(text: str | Column, keep_trailing: bool = True) -> Column:
    """Lines of a text. Without ``keep_trailing`` a final newline ends the last line (W10, T3)."""
    t = F.coalesce(col(text), F.lit(""))
    return F.split(t, "\n") if keep_trailing else F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n"))


def stripped_lines(text: str | Column) -> Column:
    """Lines as (l, s): as they are, and stripped."""
    return F.transform(split_lines(text), lambda x: F.struct(x.alias("l"), strip(x).alias("s")))


def head(lines: Column, k: int) -> Column:
    """W6."""
    return F.slice(lines, 1, k)


def tail(lines: Column, k: int) -> Column:
    """W6."""
    return F.slice(lines, F.greatest(F.size(lines) - k + 1, F.lit(1)), F.lit(k))


def candidates(lines: Column, k: int, below: int) -> Column:
    """U1, P10. Distinct stripped head and tail lines, not empty and shorter than ``below``."""
    both = F.transform(F.array_union(head(lines, k), tail(lines, k)), strip)
    return F.array_distinct(F.filter(both, lambda x: F.length(x).between(1, below - 1)))


def is_digits(line: Column) -> Column:
    """P9, on any line."""
    return line.rlike("^" + DIGITS)


def is_chapter_title(line: Column) -> Column:
    """P6, on a stripped line."""
    return line.rlike(anchored(*CHAPTERS, DIGITS, *PAGE_NUMBERS)) | ((F.length(line) < 30) & line.rlike(TITLE_WORDS))


def is_sidebar_title(line: Column) -> Column:
    """P7, on a stripped line."""
    return ((F.length(line) <= 30) & line.rlike(SIDEBAR_WORDS)) | line.rlike(anchored(DIGITS, *PAGE_NUMBERS))


def is_title_near_blank(line: Column, before: Column, after: Column, stripped: Column | None = None) -> Column:
    """P8, W5. before and after are the neighbours, null where there is none."""
    edge = F.coalesce(is_blank(before), F.lit(True)) | F.coalesce(is_blank(after), F.lit(True))
    return ((F.length(strip(line) if stripped is None else stripped).between(1, 20)) & line.rlike(NEAR_BLANK_WORDS) & edge) | line.rlike(anchored(DIGITS, PAGE_NUMBERS[0]))


def is_preamble(line: Column) -> Column:
    """P4, on a stripped line."""
    found = F.lit(False)
    for p in PREAMBLE:
        found = found | line.startswith(p)
    return found


def drop_preamble(text: str | Column, rule: int = 10, drop_blank: bool = False) -> Column:
    """P3. Without the lines from a file or page line through the next rule of ``rule`` signs.

    The state runs over the text, so one regular expression removes each such stretch; an
    unmatched start takes the rest. Its loops are possessive: Java runs those without
    recursion, so a stretch may have any number of lines. ``drop_blank`` also drops blank lines.
    """
    sign = "=" * rule
    start = r"(?:PDFファイル:|ページ番号:)"
    stretch = rf"\n{start}[^\n]*+(?:\n(?!{sign})[^\n]*+)*+(?:\n{sign}[^\n]*+|\z)"

    def without(t: Column) -> Column:
        has = F.contains(t, F.lit("PDFファイル:")) | F.contains(t, F.lit("ページ番号:"))
        # what is left begins with the newline that was set before it, or is empty
        return F.when(has, F.substring(F.regexp_replace(F.concat(F.lit("\n"), t), stretch, ""), F.lit(2), F.length(t))).otherwise(t)

    kept = let(F.coalesce(col(text), F.lit("")), without)
    return F.array_join(F.filter(F.split(kept, "\n"), lambda x: ~is_blank(x)), "\n") if drop_blank else kept


def merge_short(lines: Column, least: int = 10) -> Column:
    """W9. Stripped lines; one shorter than ``least`` joins the line before it, blanks vanish."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    marked = F.transform(full, lambda x, i: F.when((i == 0) | (F.length(x) >= least), F.concat(F.lit("\n"), x)).otherwise(x))
    return F.regexp_replace(F.array_join(marked, ""), r"\A\n", "")
