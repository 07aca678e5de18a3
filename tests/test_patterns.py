"""Very many literals against one replacement after the other."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions import patterns
from textloom.functions import text as X


def one_by_one(text, literals):
    for x in literals:
        text = text.replace(x, "") if x else text
    return text


@settings(max_examples=600, deadline=None)
@given(st.text("abあ\U0001f9ff", max_size=60), st.lists(st.text("abあ\U0001f9ff", max_size=4), max_size=40))
def test_same_as_one_by_one(text, literals):
    assert patterns.Literals(literals).remove(text) == one_by_one(text, literals)


def test_cuts_in_long_texts():
    rng = random.Random(4)
    for _ in range(20):
        literals = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
        text = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
        assert patterns.Literals(literals).remove(text) == one_by_one(text, literals)


def test_thousands_on_a_megabyte():
    literals = [f"name{k}@mail" for k in range(20_000)]
    text = "plain words of a long page " * 40_000 + "name19999@mail name7@mail"
    held = patterns.Literals(literals)
    start = time.time()
    assert held.remove(text) == "plain words of a long page " * 40_000 + " "
    assert time.time() - start < 5


def test_regular_expressions_keep_their_place(spark):
    many = [f"x{k}y" for k in range(200)]
    df = spark.createDataFrame([("ax1x2yy9b", "x"), (None, "y"), ("", "z")], "text string, k string")
    out = [r[0] for r in df.select(X.remove_patterns("text", ["regex:[0-8]y", *many, "regex:[0-9]+"])).collect()]
    assert out == ["axxyb", None, ""]
