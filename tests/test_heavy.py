"""Frequent lines by summaries: nothing wanted is missed, and what is shuffled is bounded."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import cleaning
from textloom.sources import shared


def corpora(spark, n=3000):
    """Corpora of mostly unique lines; some lines on exactly 40 %, some just below, one on a third of all pages."""
    rng = random.Random(n)
    rows = []
    for corpus, size in (("hot", n), ("small", 10), ("one", 1), ("two", 2), ("odd", 97)):
        for k in range(size):
            lines = [f"{corpus} {k} {i} {rng.random()}" for i in range(12)]
            if 5 * k < 2 * size:
                lines[0], lines[11] = "on 40 %", "last on 40 %"
            elif k % 3 == 0:
                lines[1] = "on fewer"
            if k % 2:
                lines[2] = lines[3] = f"Page {k}"
            rows.append((corpus, k, "\n".join(lines)))
    return rows, spark.createDataFrame(rows, "corpus_id string, page_num int, text string").repartition(7)


def test_repeated_lines_are_exact(spark):
    rows, pages = corpora(spark)
    counts, sizes = Counter(), Counter(c for c, _, _ in rows)
    for c, _, text in rows:
        lines = text.split("\n")
        counts.update({(c, x) for x in lines[:5] + lines[-5:] if 0 < len(x) < 100})
    want = {(c, x, n) for (c, x), n in counts.items() if 10 * n >= 4 * sizes[c]}
    assert {("hot", "on 40 %", 1200), ("hot", "last on 40 %", 1200)} <= want
    assert {tuple(r) for r in cleaning.repeated_lines(pages).collect()} == want


def test_few_lines_pass_the_summaries(spark):
    _, pages = corpora(spark)
    ends = pages.select("corpus_id", F.split("text", "\n").alias("lines")).select("corpus_id", F.concat(F.slice("lines", 1, 5), F.slice("lines", 8, 5)).alias("lines"))
    heavy = {r["corpus_id"]: r["heavy"] for r in cleaning.heavy_lines(ends, F.col("lines"), 10, 0.4).collect()}
    assert all(len(x) <= 50 for x in heavy.values()) and {"on 40 %", "last on 40 %"} <= set(heavy["hot"])
    assert len(heavy["hot"]) < 10  # of 27,000 different lines


def test_patterns_are_exact(spark):
    rows, pages = corpora(spark, 400)
    framed = pages.withColumn("text", F.concat(F.lit("Title 7\n"), "text", F.lit("\nend 12 of 90")))
    n, top, bottom, sizes = Counter(), Counter(), Counter(), Counter(c for c, _, _ in rows)
    for c, _, text in rows:
        lines = [re.sub(r"\d+", "[NUM]", x) for x in ["Title 7", *text.split("\n"), "end 12 of 90"]]
        n.update((c, x) for x in lines[:3] + lines[-3:])
        top.update({(c, x) for x in lines[:3]})
        bottom.update({(c, x) for x in lines[-3:]})
    want = {(*k, v, "header" if top[k] > bottom[k] else "footer") for k, v in n.items() if 2 * v >= sizes[k[0]]}
    assert {("hot", "Title [NUM]", 400, "header"), ("hot", "end [NUM] of [NUM]", 400, "footer")} <= want
    assert {tuple(r) for r in cleaning.header_footer_patterns(framed).collect()} == want


@pytest.mark.parametrize("make", [cleaning.repeated_lines, cleaning.header_footer_patterns])
def test_intermediate_tables_go(spark, make):
    _, pages = corpora(spark, 50)
    root = spark._jvm.org.apache.hadoop.fs.Path(shared.shared_folder(spark))
    system = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = lambda: {x.getPath().getName() for x in system.listStatus(root)} if system.exists(root) else set()
    before = names()
    make(pages)
    assert len(names() - before) == 1  # the result
