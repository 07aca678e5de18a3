"""Whole jobs: folders or tables in, Parquet or text out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.functions import lines as L
from textloom.functions import text as X
from textloom.operators import cleaning, collection, narration, segment, tabular
from textloom.sources import pages as P


def clean_folder(spark: SparkSession, folder: str, out: str, keep_chapters: bool = False) -> DataFrame:
    """Clean a folder of page files into Parquet, one part folder for each corpus; returns page counts."""
    pages = P.with_places(P.read_pages(spark, folder))
    cleaning.clean_corpus(pages, keep_chapters).write.partitionBy("corpus_id").parquet(out)
    return cleaning.corpus_statistics(pages)


def narrate_folder(spark: SparkSession, folder: str, catalogue: DataFrame, out: str, speaker: str | None = None, natural: bool = True) -> None:
    """Page files to a table of synthesis requests."""
    from pyspark.sql import functions as F

    pages = P.with_places(P.read_pages(spark, folder)).withColumn("text", segment.format_text("text", "hybrid"))
    pages = cleaning.where_made(pages.withColumn("text", L.drop_preamble("text", drop_blank=True)), ~X.is_blank("text"))
    parts = segment.chunk_table(pages, segment.split_naturally("text") if natural else segment.split_bounded("text"))
    unset = {c: F.lit(None).cast(t) for c, t in (("speaker_id", "int"), ("speed", "double"), ("pitch", "double"), ("pause", "double"), ("intonation", "double"))}
    narration.requests(parts.withColumn("speaker", F.lit(speaker).cast("string")).withColumns(unset), catalogue, natural).write.partitionBy("corpus_id").parquet(out)


def normalise_list(spark: SparkSession, rows: DataFrame, out: str) -> None:
    """Tab-separated groups and members (row_no, value) to three tables and their INSERT statements."""
    fields = tabular.tsv_fields(rows).selectExpr("row_no", "fields[0] as name", "fields[1] as members")
    groups, members, bridge = tabular.group_members(fields)
    for name, df in (("groups", groups), ("members", members)):
        df.write.parquet(f"{out}/{name}")
        tabular.insert_statements(name, df, {"id": "int", "name": "str"}, "id").orderBy("batch_no").select("statement").write.text(f"{out}/{name}_sql")
    bridge.write.parquet(f"{out}/group_member")


def collection_report(paths: DataFrame, out: str) -> None:
    """Manifest of paths to the report, one file ``report.md`` in the folder ``out``."""
    collection.write_report(collection.album_tracks(paths), out)


def page_folders(pages: DataFrame, out: str, single: bool = False) -> None:
    """Pages to text files: one for each page under its number, or one for each corpus."""
    P.write_documents(pages, out) if single else P.write_page_files(pages, out)
