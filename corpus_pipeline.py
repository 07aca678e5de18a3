"""The corpus pipeline: language ID, near-duplicates, decontamination, secrets, tokens.

Odd rows, in every stage: an empty table gives an empty table; columns beyond those of
documents stay as they are, whatever their names, up to the last stage; ties go to the
smallest doc_id. Each stage's docstring tells what becomes of nulls and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, langid, neardup, secrets
from textloom.sources.shared import discard, materialize, spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is identified (evidence fused over text, tag and host).

    Null texts and texts of fewer than three bytes go; a null lang or source is no evidence.
    Repeated rows share their fate.
    """
    found = langid.identify(docs, langid.fit_text(docs))
    return found.where("lang_accepted").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of similarity 0.8 or more.

    Null texts and texts without words are alike to nothing and stay, as do rows without an
    id. Of rows of one id one stays, the first by text, lang, source and n_chars.
    """
    dropped = neardup.components(docs, percent=80).where("not kept").select("doc_id").distinct()
    kept = docs.join(dropped.hint("merge"), "doc_id", "left_anti")
    # the join has the rows by id already, so this sorts but does not shuffle; rows without an id stay apart
    apart = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    first = Window.partitionBy("doc_id", "__apart").orderBy("text", "lang", "source", "n_chars")
    return kept.withColumn("__apart", apart).withColumn("__place", F.row_number().over(first)).where("__place = 1").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, up to a fifth of its words edited.

    Null and empty texts stay; null and empty items are found nowhere. Repeated rows share
    their fate.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaked(docs, benchmark, name="__leaked", free_ends=True).where("not __leaked").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; n_chars follows the new text.

    A null text stays null, and its n_chars becomes null. Every row stays.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in others)).alias("others"))
    found = secrets.scan(rows, keep=("others",), redact=True)
    clean = found.select("others.*", F.col("redacted").alias("text"), F.length("redacted").cast("long").alias("n_chars"))
    return clean.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the text that they decode to.

    A null text has no tokens and decodes to the empty text. Every row stays, with the
    columns of documents only, n_tokens and ids.
    """
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep=("doc_id", "lang", "source", "n_chars"))
    return coded.select("doc_id", F.col("decoded").alias("text"), "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("tokens", tokens),
]

#: No SQL for the stages: their models and searches have none. tests/llm hold each to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written and read again.

    What a stage was given is deleted when the next one's rows are written.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return docs
