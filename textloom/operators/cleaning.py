"""Corpus cleaners: repeated head and tail lines, titles, duplicates, blank runs.

A corpus is (corpus_id, page_num, text). Summaries of frequent lines and the counts of those
that may be wanted are the only shuffles; the pages themselves are cleaned in their rows, by array functions over columns that are made once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import lines as L
from textloom.functions import text as X
from textloom.sources.shared import discard, materialize


def where_made(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on columns that are costly to make, where they are made.

    The optimizer would push the condition below the projections and so make the columns
    twice, array columns even once for each element; a row number is no expression that it
    may move.
    """
    return df.withColumn("__n", F.monotonically_increasing_id()).where(condition & (F.col("__n") >= 0)).drop("__n")


def heavy_lines(ends: DataFrame, lines: Column, per_page: int, share: float) -> DataFrame:
    """(corpus_id, heavy): for each corpus all lines that may be on ``share`` of its pages, written.

    ``lines`` is an array of at most ``per_page`` lines of a page. So a wanted line is one in
    ``per_page / share`` of all at least, of which there are no more than that, and a summary of
    frequent items with a few hundred counters can't miss it: its error is below half that share
    of the lines. Tasks send one summary for each corpus, whatever the number of lines.
    """
    most = max(1, math.ceil(per_page / share))
    counters = 1 << math.ceil(math.log2(7 * most))
    top = F.call_function("approx_top_k", F.col("line"), F.lit(2 * most), F.lit(counters))
    found = ends.select("corpus_id", F.explode(lines).alias("line")).groupBy("corpus_id").agg(top.alias("t"))
    return materialize(found.select("corpus_id", F.transform("t", lambda x: x["item"]).alias("heavy")), "heavy-lines")


def repeated_lines(pages: DataFrame, k: int = 5, below: int = 100, tenths: int = 4, min_pages: int = 0) -> DataFrame:
    """A1. (corpus_id, line, n): head and tail lines on at least ``tenths`` tenths of a corpus's pages.

    A page counts a line once; blank pages count as pages. min_pages is 0 or 2. Only lines that
    summaries of frequent items let through are counted, exactly, with partial counts; the
    others, mostly unique, are never shuffled.
    """
    found = L.candidates(L.split_lines("text", keep_trailing=False), k, below)
    ends = materialize(pages.select("corpus_id", found.alias("lines")), "ends")
    heavy = heavy_lines(ends, F.col("lines"), 2 * k, tenths / 10)
    few = ends.join(heavy, "corpus_id").select("corpus_id", F.explode(F.array_intersect("lines", "heavy")).alias("line"))
    counted = few.groupBy("corpus_id", "line").agg(F.count("*").alias("n"))
    sizes = ends.groupBy("corpus_id").agg(F.count("*").alias("pages"))
    kept = counted.join(sizes, "corpus_id").where((10 * F.col("n") >= tenths * F.col("pages")) & (F.col("n") >= min_pages))
    out = materialize(kept.select("corpus_id", "line", "n"), "repeated")
    discard(ends, heavy)
    return out


def header_footer_patterns(pages: DataFrame, k: int = 3, halves: int = 1) -> DataFrame:
    """A2, A3. (corpus_id, pattern, n, kind): normalised head and tail lines on half the pages.

    n counts occurrences, so a page of few lines counts a line in both ends. kind is header
    if more pages have the pattern among the first lines than among the last, else footer.
    One grouped pass over the patterns that :func:`heavy_lines` lets through does both.
    """
    lines = L.split_lines("text")
    norm = lambda a: F.filter(F.transform(a, lambda x: X.normalize_for_comparison(X.strip(x))), lambda x: x != "")
    ends = materialize(pages.select("corpus_id", norm(L.head(lines, k)).alias("top"), norm(L.tail(lines, k)).alias("bottom")), "ends")
    heavy = heavy_lines(ends, F.concat("top", "bottom"), 2 * k, halves / 2)

    def marks(end: str, top: int) -> Column:
        def mark(x: Column, i: Column) -> Column:
            first = F.when(F.array_position(end, x) == i + 1, 1).otherwise(0)
            return F.struct(x.alias("pattern"), F.lit(1).alias("n"), (first * top).alias("t"), (first * (1 - top)).alias("b"))

        return F.filter(F.transform(end, mark), lambda m: F.array_contains("heavy", m["pattern"]))

    few = ends.join(heavy, "corpus_id").select("corpus_id", F.inline(F.concat(marks("top", 1), marks("bottom", 0))))
    counted = few.groupBy("corpus_id", "pattern").agg(*(F.sum(c).alias(c) for c in ("n", "t", "b")))
    sizes = ends.groupBy("corpus_id").agg(F.count("*").alias("pages"))
    kept = counted.join(sizes, "corpus_id").where(2 * F.col("n") >= halves * F.col("pages"))
    out = materialize(kept.select("corpus_id", "pattern", "n", F.when(F.col("t") > F.col("b"), "header").otherwise("footer").alias("kind")), "patterns")
    discard(ends, heavy)
    return out


def with_patterns(pages: DataFrame, patterns: DataFrame, line: str = "line") -> DataFrame:
    """The pages with the removal set of their corpus, ``repeated``: one row for each corpus (J5, U2).

    The sets are written once, so that Catalyst has their size in bytes: it broadcasts them
    below spark.sql.autoBroadcastJoinThreshold, else it shuffles and AQE splits a hot corpus.
    """
    sets = materialize(patterns.groupBy("corpus_id").agg(F.collect_set(line).alias("repeated")), "line-sets")
    return pages.join(sets, "corpus_id", "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<string>")))


def clean_corpus(pages: DataFrame, keep_chapters: bool = False, reformat: bool = True) -> DataFrame:
    """Integrated cleaner: (corpus_id, page_num, text), non-blank pages only.

    In order: P4, J5 (A1 with 5 lines, below 150, 40 %, two pages at least), P7 (off with
    ``keep_chapters``), W1b, W3, strip; then X4 and X3 with ``reformat``; P1.
    """
    pages = pages.withColumn("text", X.newlines("text"))
    known = with_patterns(pages, repeated_lines(pages, 5, 150, 4, 2))

    def stays(t: Column) -> Column:
        bad = L.is_preamble(t["s"]) | F.array_contains("repeated", t["s"])
        return (t["s"] == "") | ~(bad if keep_chapters else bad | L.is_sidebar_title(t["s"]))

    step = known.select("corpus_id", "page_num", F.filter(L.stripped_lines("text"), stays).alias("t"))
    # blanks before each full line: its place among all, less its place among the full ones
    step = step.withColumn("t", F.filter(F.transform("t", lambda t, i: t.withField("p", i)), lambda t: t["s"] != ""))
    step = step.withColumn("t", F.transform("t", lambda t, i: F.struct(t["l"].alias("l"), t["s"].alias("s"), (t["p"] - i).alias("q"))))
    same = lambda t, i: (F.length(t["s"]) < 50) & F.coalesce(F.get("t", i - 1)["s"] == t["s"], F.lit(False))
    step = step.withColumn("u", F.filter("t", lambda t, i: ~same(t, i))).drop("t")
    gap = lambda u, i: F.when(F.get("u", i - 1)["q"] < u["q"], "\n").otherwise("")
    text = X.strip(F.array_join(F.transform("u", lambda u, i: F.concat(gap(u, i), u["l"])), "\n"))
    out = step.select("corpus_id", "page_num", text.alias("text"))
    if reformat:
        out = out.withColumn("text", X.remove_spaces("text")).withColumn("text", X.clean_text("text"))
    return where_made(out, ~X.is_blank("text"))


def remove_headers(pages: DataFrame, keep_chapters: bool = False, min_pages: int = 0) -> DataFrame:
    """Header remover: (corpus_id, page_num, text); lines keep their own newline.

    In order: W4, blank runs (W3, the first blank as it is), J5 (A1 with 5 lines, below 100,
    40 %), P6 (off with ``keep_chapters``), P9, W1a.
    """
    known = with_patterns(pages, repeated_lines(pages, 5, 100, 4, min_pages))
    text = F.coalesce(F.col("text"), F.lit(""))
    step = known.select("corpus_id", "page_num", "repeated", text.endswith("\n").alias("ended"), L.split_lines("text", keep_trailing=False).alias("l"))
    lines = F.transform("l", lambda x, i: F.struct(x.alias("l"), X.strip(x).alias("s"), i.alias("p")))
    step = step.withColumn("t", lines).withColumn("n", F.size("l")).drop("l")
    title = lambda s: (s != "") & ~F.array_contains("repeated", s) & L.is_chapter_title(s)
    marked = F.transform("t", lambda t: F.struct(t["l"].alias("l"), t["s"].alias("s"), t["p"].alias("p"), (F.lit(False) if keep_chapters else title(t["s"])).alias("title")))
    step = step.withColumn("t", marked)

    def stays(t: Column, i: Column) -> Column:
        behind_title = F.coalesce(F.get("t", i - 1)["title"], F.lit(False))
        return F.when(t["s"] == "", ~behind_title).otherwise(~t["title"] & ~F.array_contains("repeated", t["s"]) & ~L.is_digits(t["s"]))

    step = step.withColumn("u", F.filter("t", stays)).drop("t", "repeated")

    def kept(u: Column, i: Column) -> Column:
        before = F.coalesce(F.get("u", i - 1)["s"], F.lit("-"))
        start = i == 0
        return F.when(u["s"] == "", start | (before != "")).otherwise(start | (F.length(u["s"]) >= 30) | (before != u["s"]))

    step = step.withColumn("v", F.filter("u", kept)).drop("u")
    unended = (F.element_at("v", -1)["p"] == F.col("n") - 1) & ~F.col("ended")
    joined = F.array_join(F.transform("v", lambda v: v["l"]), "\n")
    out = F.when(F.size("v") == 0, F.lit("")).otherwise(F.concat(joined, F.when(unended, "").otherwise("\n")))
    return step.select("corpus_id", "page_num", out.alias("text"))


def clean_pages(pages: DataFrame, patterns: Sequence[str] = (), auto_detect: bool = True) -> DataFrame:
    """Layout-aware cleaner: (corpus_id, page_num, text).

    In order: P8, J5 on X5 (headers and footers, A2 and A3; off without ``auto_detect``), P9,
    W2, P5, W3, strip.
    """
    if auto_detect:
        pages = with_patterns(pages, header_footer_patterns(pages), "pattern")
    else:
        pages = pages.withColumn("repeated", F.array().cast("array<string>"))
    # raw and stripped lines in one array, named several times below, so that the optimizer keeps
    # it in a projection of its own instead of stripping the page again at every line
    step = pages.select("corpus_id", "page_num", "repeated", L.stripped_lines("text").alias("a"))

    def stays(t: Column, i: Column) -> Column:
        s = t["s"]
        five = F.slice("a", F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5)))
        seen = (F.length(s) <= 30) & (i > 0) & F.exists(five, lambda x: x["s"] == s)
        title = L.is_title_near_blank(t["l"], F.get("a", i - 1)["s"], F.get("a", i + 1)["s"], s)
        return ~(title | F.array_contains("repeated", X.normalize_for_comparison(s)) | L.is_digits(s) | seen)

    step = step.select("corpus_id", "page_num", F.array_join(F.transform(F.filter("a", stays), lambda t: t["l"]), "\n").alias("t"))
    text = X.remove_patterns("t", patterns) if patterns else F.col("t")
    return step.select("corpus_id", "page_num", X.strip(F.array_join(X.collapse_blank_lines(F.split(text, "\n")), "\n")).alias("text"))


def corpus_statistics(pages: DataFrame) -> DataFrame:
    """A8. (corpus_id, pages, with_text) of each corpus."""
    return pages.groupBy("corpus_id").agg(F.count("*").alias("pages"), F.count_if(~X.is_blank("text")).alias("with_text"))


def run_statistics(pages: DataFrame, results: DataFrame) -> DataFrame:
    """A8. (corpus_id, pages, with_text, processed, succeeded) of a run that made ``results`` from ``pages``.

    processed counts the pages with a text to work on, succeeded those whose result has one.
    """
    done = results.groupBy("corpus_id").agg(F.count_if(~X.is_blank("text")).alias("succeeded"))
    read = corpus_statistics(pages).withColumn("processed", F.col("with_text"))
    return read.join(done, "corpus_id", "left").select("corpus_id", "pages", "with_text", "processed", F.coalesce("succeeded", F.lit(0)).alias("succeeded"))
