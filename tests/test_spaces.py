"""Rules at spaces in one pass against the rules in a row; long lines with few commas."""

import random
import re
import time

import pytest

from textloom.functions import text as X
from textloom.operators import segment


@pytest.mark.parametrize("method", ["clean", "x10"])
def test_few_commas_in_a_long_line(spark, method):
    text = "あ、い、う、え、" + "か" * 200_000
    out = X.clean_only("t") if method == "x10" else segment.format_text("t", "clean")
    start = time.time()
    assert spark.createDataFrame([(text,)], "t string").select(out).first()[0] == "あ、い、う、\nえ、" + "か" * 200_000
    assert time.time() - start < 15


def spaced_by_rules(text):
    """X4's rules on the text of one stripped line, one after the other."""
    j, p = "[ぁ-ゔァ-ヶー一-龠々〆〇]", "[ぁ-ゔァ-ヶー一-龠]"
    text = re.sub(f"({j}) +({j})", r"\1\2", text)
    text = re.sub(f"({p}) +([。、！？」』）】])", r"\1\2", text)
    text = re.sub(f"([「『（【]) +({p})", r"\1\2", text)
    text = re.sub(r"(\d) +([年月日時分秒円個本枚冊])", r"\1\2", text)
    return re.sub(" {2,}", " ", text)


def cleaned_by_rules(text):
    """X3's rules on one line."""
    j = "[ぁ-ゔァ-ヶー一-龠々〆〇]"
    text = re.sub(" {2,}", " ", text)
    text = re.sub(r" ([。、！？）」』】\)])", r"\1", text)
    text = re.sub(r"([（「『【\(]) ", r"\1", text)
    return re.sub(f"({j}) +({j})", r"\1\2", text).strip()


def test_one_pass_is_the_rules_in_a_row(spark):
    rng = random.Random(3)
    signs = [*"あア漢々〇。、」「（）()1２年月x", "\U0001d7ce", "\U0001f9ff", " ", " ", " ", "  ", "   "]
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randrange(40))).strip()) for k in range(3000)]
    got = spark.createDataFrame(rows, "k int, t string").select("k", X.remove_spaces("t").alias("x4"), X.clean_text("t").alias("x3")).collect()
    assert {r["k"]: (r["x4"], r["x3"]) for r in got} == {k: (spaced_by_rules(t), cleaned_by_rules(t)) for k, t in rows}
