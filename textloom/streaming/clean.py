"""The narrow text functions on a stream of page files. Nothing here keeps a state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import lines as L
from textloom.functions import text as X
from textloom.operators import segment


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text) of the page files that arrive in a folder."""
    raw = spark.readStream.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return raw.select(F.col("_metadata.file_name").alias("file_name"), X.newlines("value").alias("text"))


def format_stream(pages: DataFrame, method: str = "clean") -> DataFrame:
    """The stream with preambles off and texts formatted by a method of :mod:`segment`."""
    return pages.withColumn("text", segment.format_text(L.drop_preamble("text"), method))


def write_stream(pages: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append to Parquet; ``once`` takes what is there and ends."""
    writer = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
