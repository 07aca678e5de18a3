"""The thin queries over the standard tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, ctw, decontaminate, hardneg, langid, neardup, periodic, quality, rules, secrets, substrings, toxicity, vecdup
from textloom.llm._columns import remainder, spread


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that repeat fifty or more words of an earlier one, removed."""
    kept = substrings.deduplicate(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a context-tree model and a word unigram base."""
    docs = documents(spark, sf_dir)
    rest = remainder("doc_id", 7)
    scored = ctw.score(docs, learn=(rest != 2) & (rest >= 0))
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_decode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def labelled(docs: DataFrame, spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Texts and labels of the rows that may be learned from: remainder of 5 not 0, label known."""
    return docs.select("doc_id", "text").join(known_labels(spark, sf_dir, label).hint("merge"), "doc_id")


def known_labels(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col(label).isNotNull() & (remainder("doc_id", 5) > 0))
    return labels.select("doc_id", label)


def scored(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from toxic training rows and unlabelled text."""
    docs = documents(spark, sf_dir)
    share = known_labels(spark, sf_dir, "toxic").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    toxic = labelled(docs, spark, sf_dir, "toxic").where("toxic = 1").select("doc_id", "text")
    unlabelled = docs.where(remainder("doc_id", 5) > 0).select("doc_id", "text")
    model = toxicity.fit(toxic, unlabelled, prior=0.1 if share is None else share)
    return scored(toxicity.score(docs.select("doc_id", "text"), model), 0.5)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled training rows."""
    docs = documents(spark, sf_dir)
    model = quality.fit(labelled(docs, spark, sf_dir, "quality"))
    return scored(quality.score(docs.select("doc_id", "text"), model), 0.3)


def of_kinds(spans: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined_spans(spans: str = "spans", kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans, comma-joined."""
    some = F.col(spans) if kinds is None else of_kinds(spans, kinds)
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document, up to a fifth of an item's words edited."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), free_ends=True)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document at shingle similarity 0.85."""
    return neardup.components(documents(spark, sf_dir), percent=85)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document, and whether base rules and weak supervision keep it."""
    judged = rules.judge(documents(spark, sf_dir))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *rules.COUNTS, failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: text, declared language and host (source) together."""
    docs = documents(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text", "lang", "source"), langid.fit_text(docs))
    return found.select("doc_id", F.col("lang").alias("declared"), "lang_id", "lang_posterior", F.col("lang_accepted").alias("kept"))


def op8_langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every web page: text, language of the markup, host and address suffix together."""
    pages = langid.page_evidence(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    found = langid.identify(pages.select("page_id", "text", "lang", "source"), langid.fit_text(pages))
    return found.select("page_id", F.col("source").alias("host"), langid.suffix(F.col("source")).alias("suffix"), F.col("lang").alias("declared"), "lang_id", "lang_posterior", F.col("lang_accepted").alias("kept"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base shapes, and literals assigned to sensitive names."""
    found = secrets.scan(documents(spark, sf_dir))
    base = ("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(of_kinds("spans", (k,))).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined_spans(kinds=base).cast("binary"), 256).alias("base_sha256"),
        joined_spans().alias("spans"),
    )


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector: for each of five positives the five best below it."""
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.select("vec_id", shifted.alias("label"), "embedding"), F.col("id") % 100 == 0)


def op12_vecdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate component of every vector at cosine 0.93."""
    return vecdup.link(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document (the contract's texts: one in ten has a repeated tail), collapsed."""
    docs = documents(spark, sf_dir)
    texts = docs.select("doc_id", periodic.repeated_tail(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.collapse(texts)
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_ctw": op2_ctw,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op10_quality": op10_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_neardup": op6_neardup,
    "op7_rules": op7_rules,
    "op8_langid": op8_langid,
    "op8_langid_pages": op8_langid_pages,
    "op9_secrets": op9_secrets,
    "op11_hardneg": op11_hardneg,
    "op12_vecdup": op12_vecdup,
    "op13_periodic": op13_periodic,
}

ORACLES: dict[str, str] = {
    "op1_substrings": substrings.oracle(),
    "op6_neardup": neardup.oracle(),
    "op7_rules": rules.oracle(),
    "op11_hardneg": hardneg.oracle(),
    "op12_vecdup": vecdup.oracle(),
}
