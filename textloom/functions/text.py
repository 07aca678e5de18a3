"""Column functions over text: white space, newlines, Japanese spacing, pause tags.

White space and digits are Unicode's, as Python's ``str.strip`` and ``\\d`` have them; Java's
``trim`` and ``\\s`` do not, so every function uses the classes below.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.patterns import remove_literals

# Character classes, tags and patterns that results depend on.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ZERO_WIDTH = r"[\u200b\u200c\u200d\u2060\ufeff]"
ZERO_WIDTH_SIGNS = "\u200b\u200c\u200d\u2060\ufeff"
ODD_SPACES = r"[\xa0\u1680\u2000-\u200a\u202f\u205f]"
JAPANESE = "[ぁ-ゔァ-ヶー一-龠々〆〇]"
JAPANESE_PLAIN = "[ぁ-ゔァ-ヶー一-龠]"
COUNTERS = "[年月日時分秒円個本枚冊]"
# Rules at runs of spaces, in one pass that starts at a space: what matches goes, but for a second Japanese
# character, which its match takes along (so the gap behind it stays, as with a pattern of both), and one
# space of a run that no rule removes. A digit of two chars has its second in \p{Cs}.
BETWEEN = rf"(?<={JAPANESE} )(?<!\G ) *+({JAPANESE})"
GAPS = (
    rf" (?:{BETWEEN}|(?<={JAPANESE_PLAIN} ) *+(?=[。、！？」』）】])|(?<=[「『（【] ) *+(?={JAPANESE_PLAIN})"
    rf"|(?<=\p{{Nd}}\p{{Cs}}? ) *+(?={COUNTERS})| *( ))"
)
GAPS_AT_MARKS = rf" (?: *+(?=[。、！？」）』】\)])|(?<=[（「『【\(] ) *+|{BETWEEN}| *( ))"
PAUSES: Sequence[tuple[str, str]] = (
    ("。", "。[pau:0.8]"),
    ("、", "、[pau:0.3]"),
    ("！", "！[pau:0.8]"),
    ("？", "？[pau:0.8]"),
    ("\n\n+", "\n[pau:1.5]\n"),
    ("「", "[pau:0.2]「"),
    ("」", "」[pau:0.2]"),
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chain(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, by in rules:
        c = F.regexp_replace(c, pattern, by)
    return c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def where_has(value: Column, sign: str, change: Callable[[Column], Column]) -> Column:
    """``change(value)`` for the texts that contain ``sign``; a byte search guards the costly rule."""
    return let(value, lambda t: F.when(F.contains(t, F.lit(sign)), change(t)).otherwise(t))


def _has_bytes(text: Column, *starts: bytes) -> Column:
    """Whether a text has one of these bytes, with which the characters of a rule begin."""
    has = F.lit(False)
    for start in starts:
        has = has | F.contains(text.cast("binary"), F.lit(start))
    return has


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def rstrip(c: str | Column) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def is_blank(c: str | Column) -> Column:
    return F.ltrim(col(c), F.lit(SPACES)) == ""


def newlines(c: str | Column) -> Column:
    """X1. CRLF and CR become LF."""
    return where_has(col(c), "\r", lambda t: F.regexp_replace(t, r"\r\n?", "\n"))


def drop_zero_width(c: str | Column) -> Column:
    """X2."""
    def without(t: Column) -> Column:
        out = t
        for sign in ZERO_WIDTH_SIGNS:  # a byte search each; a regular expression reads every character
            out = F.replace(out, F.lit(sign), F.lit(""))
        return F.when(_has_bytes(t, b"\xe2\x80", b"\xe2\x81", b"\xef\xbb\xbf"), out).otherwise(t)

    return let(col(c), without)


def per_line(c: Column, change) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), change), "\n")


def clean_text(c: str | Column, aggressive: bool = True) -> Column:
    """X3. Zero-width characters, tabs, wide spaces, spaces at brackets and marks, newlines.

    ``aggressive`` also joins Japanese characters over spaces and drops the indent of wide
    spaces; otherwise the indent stays. No rule but the strips looks across a line's end, so
    the rules run over the whole text, each behind a search for the sign it needs.
    """
    text = F.replace(drop_zero_width(c), F.lit("\t"), F.lit(" "))
    text = _clean_lines(text) if aggressive else per_line(text, _clean_keeping_indent)
    text = where_has(text, "\r", lambda t: per_line(_at_most_one_blank(newlines(t)), rstrip))
    return strip(_at_most_one_blank(text))


def _at_most_one_blank(text: Column) -> Column:
    return where_has(text, "\n\n\n", lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))


def _one_space(text: Column) -> Column:
    return where_has(text, "  ", lambda t: F.regexp_replace(t, " {2,}", " "))


def _odd_spaces(text: Column) -> Column:
    """Odd spaces as plain ones."""
    return let(text, lambda t: F.when(_has_bytes(t, b"\xe2\x80", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x81\x9f"), F.regexp_replace(t, ODD_SPACES, " ")).otherwise(t))


def _at_marks(text: Column) -> Column:
    return chain(text, [(r" ([。、！？）」』】\)])", "$1"), (r"([（「『【\(]) ", "$1")])


def _clean_lines(text: Column) -> Column:
    wide = where_has(text, "　", lambda t: F.replace(F.regexp_replace(t, "(?md)^　+", ""), F.lit("　"), F.lit(" ")))
    joined = where_has(wide, " ", lambda t: F.regexp_replace(t, GAPS_AT_MARKS, "$1$2"))
    return per_line(joined, strip)


def _clean_keeping_indent(x: Column) -> Column:
    body = _at_marks(_one_space(F.replace(F.regexp_replace(x, "^　+", ""), F.lit("　"), F.lit(" "))))
    indent = F.regexp_extract(x, "^(　+)", 1)
    return F.when(indent != "", F.concat(indent, body)).otherwise(strip(body))


def collapse_blank_lines(lines: Column) -> Column:
    """W3. Of each run of blank lines one stays, as an empty line."""
    empty = F.transform(lines, lambda x: F.when(is_blank(x), F.lit("")).otherwise(x))
    return let(empty, lambda e: F.filter(e, lambda x, i: (x != "") | (i == 0) | (F.get(e, i - 1) != "")))


def collapse_empty_lines(text: Column) -> Column:
    """W3 on a text whose blank lines are empty."""
    text = where_has(text, "\n\n", lambda t: _at_most_one_blank(chain(t, [(r"\A\n+\z", ""), (r"\A\n{2,}", "\n"), (r"\n{2,}\z", "\n")])))
    return let(text, lambda t: F.when(t == "\n", F.lit("")).otherwise(t))


def remove_spaces(c: str | Column) -> Column:
    """X4. Odd spaces, strip each line, join Japanese over spaces, digits and counters; W3.

    The rules do not look across a line's end, so they run over the whole text.
    """
    lines = per_line(_odd_spaces(col(c)), strip)
    return collapse_empty_lines(where_has(lines, " ", lambda t: F.regexp_replace(t, GAPS, "$1$2")))


def normalize_for_comparison(c: str | Column) -> Column:
    """X5. Digits become [NUM], runs of white space one space, ends stripped."""
    return strip(chain(col(c), [(r"\p{Nd}+", "[NUM]"), (f"{SPACE}+", " ")]))


def pause_tags(c: str | Column) -> Column:
    """X7. Pause tags behind marks, at paragraphs and brackets."""
    return chain(col(c), PAUSES)


def clean_only(c: str | Column) -> Column:
    """X10. X4, X3, then long lines broken behind each full stop and each third comma; W3.

    A long line that ends in a full stop keeps the newline behind it, so that a blank line
    follows.
    """
    # behind the last match no other can start, so none is looked for
    third = r"\G((?:[^、\n]*+、){3})"

    def commas(x: Column) -> Column:
        return F.length(x) - F.length(F.replace(x, F.lit("、"), F.lit("")))

    def part(x: Column) -> Column:
        many = (F.length(x) > 60) & (commas(x) > 3)
        return F.when(many, F.regexp_replace(x, third, "$1\n")).otherwise(x)

    def line(x: Column) -> Column:
        ended = F.replace(x, F.lit("。"), F.lit("。\n"))
        broken = F.when(commas(x) > 3, F.array_join(F.transform(F.split(ended, "\n"), part), "\n")).otherwise(ended)
        return F.when(F.length(x) > 80, broken).otherwise(x)

    lines = F.transform(F.split(clean_text(remove_spaces(c)), "\n"), lambda x: let(strip(x), line))
    return F.array_join(collapse_blank_lines(lines), "\n")


#: Literals in a row from which an automaton looks for them all at once.
MANY = 64


def remove_patterns(c: str | Column, patterns: Sequence[str]) -> Column:
    """P5. Literals, or regular expressions behind ``regex:``, removed in the given order.

    Few are one expression each. MANY literals in a row or more, thousands too, are looked for by
    one automaton, and only those that a text has are applied; the result is the same.
    """
    out = col(c)
    for regex, group in groupby(patterns, lambda p: p.startswith("regex:")):
        some = list(group)
        if not regex and len(some) >= MANY:
            out = remove_literals(out, some)
            continue
        for p in some:
            out = F.regexp_replace(out, p[6:], "") if regex else F.replace(out, F.lit(p), F.lit(""))
    return out


def page_name(n: str | Column) -> Column:
    """X18. page_0001.txt and so on."""
    return F.format_string("page_%04d.txt", col(n))


def derived_name(path: str | Column, ending: str) -> Column:
    """X18. The stem of a path with another ending, such as ``.wav`` or ``_formatted.txt``."""
    return F.concat(F.regexp_replace(F.regexp_extract(col(path), r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", ""), F.lit(ending))
