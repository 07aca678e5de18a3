"""Sources and sinks of pages, delimited rows and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.operators import tabular
from textloom.sources import files
from textloom.sources.shared import materialize

#: Page numbers of one part of a document.
PAGES_IN_PART = 64
#: Splits of a folder of files that one task reads.
SPLITS_IN_TASK = 32


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """S1, O5. (corpus_id, page_num, file_name, text): one row for each file of a folder, not recursive.

    page_num is the number in ``page_<n>``, else the file's place by name (null at read; see
    :func:`with_places`). Newlines are normalised as text readers do.
    """
    raw = _few_tasks(spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=False))
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"page_(\d+)", 1)
    corpus = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return raw.select(corpus.alias("corpus_id"), F.when(number != "", number.cast("int")).alias("page_num"), name.alias("file_name"), X.newlines("value").alias("text"))


def _few_tasks(files: DataFrame) -> DataFrame:
    """A scan of small files over fewer tasks: a split has few of them, one at worst, since Spark adds a cost for each.

    Up to SPLITS_IN_TASK splits make a task, while there are tasks enough for all cores.
    """
    splits = files.rdd.getNumPartitions()
    return files.coalesce(max(8 * files.sparkSession.sparkContext.defaultParallelism, splits // SPLITS_IN_TASK))


def with_places(pages: DataFrame) -> DataFrame:
    """O5. Pages without a number get their place by file name within the corpus.

    Only names are sorted; no task has a corpus of texts. The pages are written once, so that each
    file is opened once, not again for the names and for the bounds of their sort.
    """
    pages = materialize(pages, "pages")
    places = tabular.numbered(pages.select("corpus_id", "file_name"), ("file_name",), "place", within=("corpus_id",))
    return pages.join(places, ["corpus_id", "file_name"]).withColumn("page_num", F.coalesce("page_num", F.col("place").cast("int"))).drop("place").select(*pages.columns)


def read_delimited(spark: SparkSession, path: str, columns: int, sep: str = ",") -> DataFrame:
    """S2. Rows of a file without header, all strings; short rows are padded with nulls."""
    schema = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(columns)])
    return spark.read.csv(path, schema=schema, header=False, sep=sep, multiLine=True, escape='"', mode="PERMISSIVE")


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """S7. Removal patterns of a file, in order: stripped, without blank and # lines."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(X.newlines("value"), "\n")).alias("n", "p"))
    kept = rows.select("n", X.strip("p").alias("p")).where("p <> ''").where(~F.col("p").startswith("#"))
    return [r["p"] for r in kept.orderBy("n").collect()]  # a parameter list, a few lines


def page_files(pages: DataFrame) -> DataFrame:
    """S5, P1. (corpus_id, page_num, file_name, header, text) of the non-blank pages.

    header has the corpus and n/total; total counts blank pages too. Write it with
    :func:`write_pages`; the file name is data.
    """
    totals = materialize(pages.groupBy("corpus_id").agg(F.count("*").alias("total")), "page-counts")
    head = F.concat(F.lit("PDFファイル: "), F.col("corpus_id"), F.lit("\nページ番号: "), F.col("page_num").cast("string"), F.lit("/"), F.col("total").cast("string"))
    rows = pages.where(~X.is_blank("text")).join(totals, "corpus_id")
    return rows.select("corpus_id", "page_num", X.page_name("page_num").alias("file_name"), head.alias("header"), "text")


#: Below the two lines of a page file's header.
RULE = "=" * 50


def write_page_files(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """S5. The non-blank pages as text files: ``<path>/<corpus_id>_pages/page_<n>.txt``.

    Each begins with corpus, n/total and a rule; runs of blank lines are collapsed (W3).
    """
    body = F.array_join(X.collapse_blank_lines(F.split(X.newlines("text"), "\n")), "\n")
    text = F.concat("header", F.lit(f"\n{RULE}\n\n"), body)
    files.write_named(page_files(pages).select(F.concat("corpus_id", F.lit("_pages")).alias("folder"), "file_name", text.alias("text")), path, overwrite)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """S1, P3. (corpus_id, page_num, total, text) of what :func:`write_page_files` has written, without the headers."""
    rows = files.read_named(spark, path)
    head, rest = F.split(F.col("text"), f"\n{RULE}\n\n", 2)[0], F.split(F.col("text"), f"\n{RULE}\n\n", 2)[1]
    number = F.regexp_extract("file_name", r"page_(\d+)", 1).cast("int")
    total = F.regexp_extract(head, r"/(\d+)\z", 1).cast("long")
    return rows.select(F.regexp_replace("folder", r"_pages\z", "").alias("corpus_id"), number.alias("page_num"), total.alias("total"), rest.alias("text"))


def write_documents(pages: DataFrame, path: str, markers: bool = False, overwrite: bool = False) -> None:
    """S6. One file ``<path>/<corpus_id>.txt`` for each corpus, with the text of :func:`whole_documents`.

    Sections are sorted by range and written to their places in the file, so a corpus of any size
    needs no more memory than one page.
    """
    sections = _sections(pages, markers).select(F.concat("corpus_id", F.lit(".txt")).alias("file"), "p.page_num", F.col("p.s").alias("text"))
    files.write_ordered(sections, ("page_num",), path, overwrite)


def write_pages(pages: DataFrame, path: str) -> None:
    """Parquet, one folder for each corpus."""
    pages.write.partitionBy("corpus_id").parquet(path)


def whole_documents(pages: DataFrame, markers: bool = False) -> DataFrame:
    """S6. (corpus_id, text): non-blank pages in order, each under its marker.

    One cell for each corpus, which the corpus must fit: at most 2 GB, and the memory of one
    task. :func:`document_parts` has the same text for a corpus of any size.
    """
    return _sections(pages, markers).groupBy("corpus_id").agg(_joined().alias("text"))


def document_parts(pages: DataFrame, pages_in_part: int = PAGES_IN_PART, markers: bool = False) -> DataFrame:
    """S6. (corpus_id, part_no, text): the texts of :func:`whole_documents` in parts of bounded size.

    A part has the pages of ``pages_in_part`` numbers in a row, from part_no *
    pages_in_part on. The parts of a corpus, joined in order of part_no, are its document;
    no task or cell has a whole corpus. Parts without pages are left out.

    Blank pages are left out. With ``markers`` they stay as a marker that says so, and a null
    text (a page that could not be read) as a marker of failure; texts follow theirs at once,
    with blank runs collapsed (W3).
    """
    part = F.floor(F.col("p.page_num") / pages_in_part).cast("long")
    return _sections(pages, markers).groupBy("corpus_id", part.alias("part_no")).agg(_joined().alias("text"))


def _sections(pages: DataFrame, markers: bool = False) -> DataFrame:
    def marker(note: str) -> Column:
        return F.concat(F.lit("\n===== ページ "), F.col("page_num").cast("string"), F.lit(f"{note} ====="))

    if not markers:
        section = F.concat(marker(""), F.lit("\n\n"), F.col("text"), F.lit("\n"))
        return pages.where(~X.is_blank("text")).select("corpus_id", F.struct("page_num", section.alias("s")).alias("p"))
    body = F.array_join(X.collapse_blank_lines(F.split(X.newlines("text"), "\n")), "\n")
    full = F.concat(marker(""), F.lit("\n"), body)
    section = F.when(F.col("text").isNull(), F.concat(marker(" (エラー)"), F.lit("\n"))).when(X.is_blank("text"), F.concat(marker(" (テキストなし)"), F.lit("\n"))).otherwise(full)
    return pages.select("corpus_id", F.struct("page_num", section.alias("s")).alias("p"))


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "")
