"""Punctuation lines against the fold as it is defined, and in linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import segment


def by_definition(text, limit):
    """The fold over the list that a split at the marks gives, the last piece included, empty or not."""
    pieces, piece = [], ""
    for c in text:
        piece += c
        if c in "。！？":
            pieces.append(piece)
            piece = ""
    out, held = [], ""
    for p in [*pieces, piece]:
        held += p
        if len(held) > limit and "、" in held:
            line = ""
            for q in held.replace("、", "、\0").split("\0"):
                if len(line) + len(q) > limit and line:
                    out.append(line)
                    line = ""
                line += q
            out.append(line)
            held = ""
        elif len(held) > limit:
            mark = next((m for m in segment.CUTS if m in held), None)
            out.append(held if mark is None else held[: held.index(mark) + len(mark)])
            held = held[len(out[-1]) :]
        elif held and held[-1] in "。！？":
            out.append(held)
            held = ""
    full = [s for s in (x.strip() for x in [*out, held]) if s]
    return "\n".join(y for x in full for y in ((x, "") if x.endswith("。") and len(x) > 30 else (x,)))


def test_lines_are_those_of_the_definition():
    rng = random.Random(2)
    for _ in range(4000):
        text = "".join(rng.choice(["あ", "い ", "漢字", "。", "！", "、", "から", "ので", "が、", "しかし", "けれど", "\n", "そして", "x" * 9]) for _ in range(rng.randrange(60)))
        if rng.random() < 0.5:
            text = text.replace("、", "")
        limit = rng.choice([3, 10, 40, 50])
        assert segment.punctuation_lines(text, limit) == by_definition(text, limit)


@pytest.mark.parametrize(("end", "lengths"), [("", [57, 112]), ("。", [57, 57, 56, 0]), ("！", [57, 57, 56])])
def test_remainder_is_cut_once_for_each_piece(end, lengths):
    a = "あ" * 55
    assert [len(x) for x in segment.punctuation_lines(f"{a}から{a}から{a}{end}", 50).split("\n")] == lengths


@pytest.mark.parametrize("unit", ["あ" * 50 + "からい。", "あいうから。", "あ" * 60 + "。", "からから" * 20 + "。", "あ" * 49 + "、", "から"])
def test_long_texts_take_seconds(unit):
    start = time.time()
    segment.punctuation_lines(unit * (1_000_000 // len(unit)), 50)
    assert time.time() - start < 10


PLAIN = {
    "punctuation": (lambda t: segment.punctuation_lines(t, 50), lambda c: segment.split_punctuation(c, 50)),
    "natural": (segment.natural_chunks, segment.split_naturally),
    "bounded": (segment.bounded_chunks, segment.split_bounded),
    "hard": (lambda t: segment.bounded_chunks(t, 60, 25), lambda c: segment.split_bounded(c, 60, 25)),
}


def texts():
    rng = random.Random(5)
    marks = ["あ", "い ", "漢字", "。", "！", "、", "から", "ので", "が、", "しかし", "けれど", "\n", "そして", "x" * 9, "\u3000", "長い文章が続いていく", "\U0001f9ff"]
    out = ["".join(rng.choice(marks) for _ in range(rng.randrange(120))) for _ in range(800)]
    return [*out, *(t.replace("、", "") for t in out[:300]), "", " ", "。", "。。\n。", "、" * 300, "あ" * 500, None]


@pytest.mark.parametrize("name", PLAIN)
def test_columns_are_the_plain_functions(spark, name):
    plain, column = PLAIN[name]
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k int, text string").select("k", column("text").alias("out"))
    got = {r["k"]: r["out"] for r in df.collect()}
    assert got == {k: None if t is None else plain(t) for k, t in rows}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_semantic_breaks_are_the_rule(spark):
    rows = [(k, t) for k, t in enumerate(texts()) if t]
    marked = spark.createDataFrame(rows, "k int, text string").select("k", segment.semantic_breaks("text").alias("out"))
    assert "Arrow" not in marked._jdf.queryExecution().executedPlan().toString()
    assert segment.break_long_clauses("あ、" + "い" * 25 + "、う") == "あ、\n" + "い" * 25 + "、\nう"
    text = "0123456789ab、" + "c" * 22 + "、0123456789、" + "q" * 30 + "、zzzzzzzzzzzz"
    broken = [x for x in segment.break_long_clauses(text).split("\n")]
    got = spark.createDataFrame([(text,)], "t string").select(segment.semantic_breaks("t")).first()[0]
    assert got.split("\n") == broken  # no line is short, no particle in it


@pytest.mark.parametrize("name", PLAIN)
def test_columns_on_a_megabyte(spark, name):
    unit = "あ" * 30 + "、" + "い" * 30 + "から" + "う" * 20 + "。短い。"
    df = spark.createDataFrame([(unit * (1_000_000 // len(unit)),)], "text string")
    start = time.time()
    assert df.select(F.length(F.to_json(F.array(PLAIN[name][1]("text")))).alias("n")).first()["n"] > 900_000
    assert time.time() - start < 30
