"""Repeated lines and page counts of corpora, kept up to date as page files arrive.

The state is a count for each line of each corpus, keyed by corpus and a slot of the line's
hash, so that a corpus of very many pages is many keys. A batch's changes are appended to a
table; a count only grows, so the greatest is the current one, and a batch that is written
twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textloom.functions import lines as L
from textloom.functions import text as X

#: Keys of a corpus.
SLOTS = 64
#: No line is empty or has a newline: under these names pages, and pages with text, are counted.
PAGES, WITH_TEXT = "", "\n"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LineCounts(StatefulProcessor):
    """How often each line of a key has come; of a batch the new counts of the lines in it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "line string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}
        for part in rows:
            for line, n in part["line"].value_counts().items():
                found[line] = found.get(line, 0) + int(n)
        for line in found:
            before = self.counts.getValue((line,))
            found[line] += before[0] if before is not None else 0
            self.counts.updateValue((line,), (found[line],))
        yield pd.DataFrame({"corpus_id": key[0], "slot": key[1], "line": list(found), "n": list(found.values())})

    def close(self) -> None:
        pass


def read_pages_stream(spark: SparkSession, folder: str, files_at_a_time: int = 1000) -> DataFrame:
    """(corpus_id, text) of the page files that arrive in the folders of ``folder``, one folder a corpus."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_at_a_time).text(f"{folder}/*", wholetext=True, pathGlobFilter="*.txt")
    corpus = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return raw.select(corpus.alias("corpus_id"), X.newlines("value").alias("text"))


def counted(pages: DataFrame, k: int = 5, below: int = 100) -> DataFrame:
    """Stream of (corpus_id, slot, line, n): new counts of the lines of A1 and of pages."""
    lines = L.candidates(L.split_lines("text", keep_trailing=False), k, below)
    marks = F.array(F.lit(PAGES), F.when(~X.is_blank("text"), F.lit(WITH_TEXT)))
    each = pages.select("corpus_id", F.xxhash64("text").alias("page"), F.explode(F.array_compact(F.concat(lines, marks))).alias("line"))
    # a line has one slot; pages themselves, of which there are many, are counted in all of them
    slot = F.pmod(F.when(F.col("line").isin(PAGES, WITH_TEXT), F.col("page")).otherwise(F.xxhash64("line")), F.lit(SLOTS)).cast("int")
    keyed = each.select("corpus_id", slot.alias("slot"), "line")
    return keyed.groupBy("corpus_id", "slot").transformWithStateInPandas(LineCounts(), "corpus_id string, slot int, line string, n long", "Update", "None")


def keep_counts(pages: DataFrame, out: str, checkpoint: str, k: int = 5, below: int = 100, once: bool = False) -> StreamingQuery:
    """Append the changes of each batch to the table ``out``; ``once`` takes what is there and ends."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def append(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    writer = counted(pages, k, below).writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(corpus_id, line, n) of the table: the current counts, pages among them."""
    each = spark.read.parquet(out).groupBy("corpus_id", "slot", "line").agg(F.max("n").alias("n"))
    return each.groupBy("corpus_id", "line").agg(F.sum("n").alias("n"))


def repeated_lines(spark: SparkSession, out: str, tenths: int = 4, min_pages: int = 0) -> DataFrame:
    """A1 of all pages that have come: (corpus_id, line, n)."""
    counts = current(spark, out)
    pages = counts.where(F.col("line") == PAGES).select("corpus_id", F.col("n").alias("pages"))
    lines = counts.where(~F.col("line").isin(PAGES, WITH_TEXT))
    return lines.join(pages, "corpus_id").where((10 * F.col("n") >= tenths * F.col("pages")) & (F.col("n") >= min_pages)).select("corpus_id", "line", "n")


def statistics(spark: SparkSession, out: str) -> DataFrame:
    """A8 of all pages that have come: (corpus_id, pages, with_text)."""
    counts = current(spark, out)
    sums = [F.coalesce(F.sum(F.when(F.col("line") == name, F.col("n"))), F.lit(0)).alias(to) for name, to in ((PAGES, "pages"), (WITH_TEXT, "with_text"))]
    return counts.where(F.col("line").isin(PAGES, WITH_TEXT)).groupBy("corpus_id").agg(*sums)
