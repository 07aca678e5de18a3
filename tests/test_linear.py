"""Formatting and cutting of texts: cost for each character."""

import time

import pytest
from pyspark.sql import functions as F

from textloom.functions import lines as L
from textloom.operators import segment

UNIT = "Hあanth rいうou hえwh あnd か な う, " * 2 + "おnon hあhえhえ。 short。 " + "Ing thあt お" * 4 + "。\n"

CHAINS = {
    "bounded": lambda c: F.to_json(segment.split_bounded(L.drop_preamble(segment.format_text(c, "hybrid"), drop_blank=True))),
    "natural": lambda c: F.to_json(segment.split_naturally(L.drop_preamble(segment.format_text(c, "hybrid"), drop_blank=True))),
    "hybrid": lambda c: segment.format_text(c, "hybrid"),
}


@pytest.mark.parametrize("name", CHAINS)
def test_millions_of_characters_take_seconds(spark, name):
    text = UNIT.replace(",", "、") * 200
    rows = spark.range(6_000_000 // len(text), numPartitions=1).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("t"))
    rows.limit(2).select(CHAINS[name](F.col("t"))).collect()
    start = time.time()
    rows.select(F.sum(F.length(CHAINS[name](F.col("t"))))).collect()
    assert time.time() - start < 16


def test_a_text_with_nulls_is_cut_by_the_rule(spark):
    text = "あ\0い。う\0。え" + "、" + "お" * 60
    row = spark.createDataFrame([(text,)], "t string").select(segment.split_punctuation("t", 20).alias("a"), segment.split_naturally("t", 20, 3).alias("b")).first()
    assert row["a"] == segment.punctuation_lines(text, 20) and row["b"] == segment.natural_chunks(text, 20, 3)
