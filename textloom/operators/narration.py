"""Narration: speaker catalogue and request tables for a synthesis service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import tabular
from textloom.sources.shared import materialize

CATALOGUE = "array<struct<name:string,styles:array<struct<name:string,id:int>>>>"
# Default speaker, bounds, scales and silences of a request.
DEFAULT_SPEAKER = 3
SPEED = (0.5, 2.0)
PITCH = (-0.15, 0.15)
NATURAL_PAUSE, NATURAL_INTONATION = 1.2, 1.1
SILENCES = (("。", 0.5), ("、", 0.2))


def catalogue(raw: DataFrame, json: str = "json") -> DataFrame:
    """S10, X13. (speaker, speaker_id): lower-case name_style, spaces as _; later styles win."""
    people = raw.select(F.posexplode(F.from_json(json, CATALOGUE)).alias("p", "person"))
    styles = people.select("p", F.col("person.name").alias("name"), F.posexplode("person.styles").alias("s", "style"))
    key = F.replace(F.lower(F.concat_ws("_", "name", "style.name")), F.lit(" "), F.lit("_"))
    return styles.groupBy(key.alias("speaker")).agg(F.max_by("style.id", F.struct("p", "s")).alias("speaker_id"))


def variants(catalog: DataFrame) -> DataFrame:
    """A9, X14, O4. (base, styles): catalogue keys by the part before the last _, in key order."""
    base = F.regexp_replace("speaker", r"_[^_]*\z", "")
    style = F.replace(F.col("speaker"), F.concat(F.col("base"), F.lit("_")), F.lit(""))
    keyed = catalog.withColumn("base", base).withColumn("style", style)
    packed = keyed.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("speaker", "style", "speaker_id"))).alias("v"))
    return packed.select("base", F.transform("v", lambda x: x["style"]).alias("styles"), F.transform("v", lambda x: x["speaker_id"]).alias("ids"))


def clamp(c: Column, bounds: tuple[float, float]) -> Column:
    """X15."""
    return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), c))


def requests(chunks: DataFrame, catalog: DataFrame, natural: bool = True) -> DataFrame:
    """J6, X15, X16. Chunks with a speaker id and request parameters, and ``query`` as JSON.

    chunks: corpus_id, page_num, part_no, chunk, speaker, speaker_id, speed, pitch, pause,
    intonation (nulls: defaults). An id given directly wins, 0 too; then the name; then the
    default. An unknown name gives a null id and ``error``. natural overrides pause and
    intonation. The catalogue is written once, so Catalyst broadcasts it only if its size allows.
    """
    known = materialize(catalog.select("speaker", F.col("speaker_id").alias("named")), "catalogue")
    rows = chunks.join(known, "speaker", "left")
    found = F.coalesce("speaker_id", "named", F.when(F.col("speaker").isNull(), F.lit(DEFAULT_SPEAKER)))
    speed, pitch = F.coalesce("speed", F.lit(1.0)), F.coalesce("pitch", F.lit(0.0))
    silence = F.lit(None).cast("double")
    for mark, seconds in reversed(SILENCES):
        silence = F.when(F.col("chunk").endswith(mark), F.lit(seconds)).otherwise(silence)
    out = rows.select(
        "corpus_id",
        "page_num",
        "part_no",
        "chunk",
        found.alias("speaker_id"),
        F.when(found.isNull(), F.concat(F.lit("unknown speaker: "), F.col("speaker"))).alias("error"),
        clamp(speed, SPEED).alias("speed"),
        clamp(pitch, PITCH).alias("pitch"),
        ((speed != clamp(speed, SPEED)) | (pitch != clamp(pitch, PITCH))).alias("adjusted"),
        (F.lit(NATURAL_PAUSE) if natural else F.coalesce("pause", F.lit(1.0))).alias("pause_scale"),
        (F.lit(NATURAL_INTONATION) if natural else F.coalesce("intonation", F.lit(1.0))).alias("intonation_scale"),
        silence.alias("post_silence"),
    )
    query = F.to_json(F.struct(F.col("speed").alias("speedScale"), F.col("pitch").alias("pitchScale"), F.col("pause_scale").alias("pauseLengthScale"), F.col("intonation_scale").alias("intonationScale"), F.col("post_silence").alias("postPhonemeLength")))
    return out.withColumn("query", query)


def wave_name(corpus: Column, page: Column) -> Column:
    """X18. Name of a page's audio file."""
    return F.concat(corpus, F.format_string("_page_%04d.wav", page))


def numbered(chunks: DataFrame) -> DataFrame:
    """W10. Chunks with their number in the corpus, over pages and parts."""
    return tabular.numbered(chunks, ("page_num", "part_no"), "n", within=("corpus_id",))
