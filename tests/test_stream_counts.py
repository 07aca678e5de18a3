"""Counts of a stream of page files, against the batch operators over all files so far."""

import random

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import cleaning
from textloom.streaming import repeated


def test_state_equals_the_batch_after_every_round(spark, tmp_path):
    rng = random.Random(6)
    folder, out, check = (tmp_path / x for x in ("in", "out", "check"))
    for name in ("a", "b"):
        (folder / name).mkdir(parents=True)
    for turn in range(3):
        for name, size in (("a", 14), ("b", 5)):
            for k in range(size):
                head = "Running Head" if rng.random() < 0.6 else f"chapter {rng.random()}"
                body = "" if rng.random() < 0.1 else f"{head}\r\n{rng.random()}\nsame\nsame\n{k}\nlast of {name}\n"
                (folder / name / f"page_{turn}{k:03d}.txt").write_text(body, newline="")
        query = repeated.keep_counts(repeated.read_pages_stream(spark, str(folder), 7), str(out), str(check), once=True)
        query.awaitTermination(180)
        assert query.exception() is None
        raw = spark.read.text(f"{folder}/*", wholetext=True)
        pages = raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]*$", 1).alias("corpus_id"), F.lit(1).alias("page_num"), X.newlines("value").alias("text"))
        want = {tuple(r) for r in cleaning.repeated_lines(pages).collect()}
        assert {tuple(r) for r in repeated.repeated_lines(spark, str(out)).collect()} == want and want
        stats = {tuple(r) for r in cleaning.corpus_statistics(pages).collect()}
        assert {tuple(r) for r in repeated.statistics(spark, str(out)).collect()} == stats
    state = spark.read.format("statestore").option("stateVarName", "counts").load(str(check))
    heads = state.selectExpr("key.line as line", "value.n as n") if "key.line" in state.columns else state
    assert heads.count() > 0
