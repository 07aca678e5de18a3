"""Collection report: albums and tracks from a manifest of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources import files


def album_tracks(paths: DataFrame, suffix: str = ".flac") -> DataFrame:
    """P14, A5. (artist, album, tracks) of the paths artist/album/file with the suffix."""
    parts = F.split("path", "/")
    files = paths.where((F.size(parts) == 3) & F.col("path").endswith(suffix))
    return files.groupBy(parts[0].alias("artist"), parts[1].alias("album")).agg(F.count("*").alias("tracks"))


def totals(albums: DataFrame) -> DataFrame:
    """A6. (level, artist, albums, tracks, artists): 'artist' rows and one 'all' row."""
    by_artist = albums.groupBy("artist").agg(F.count("*").alias("albums"), F.sum("tracks").alias("tracks"))
    rolled = by_artist.rollup("artist").agg(F.sum("albums").alias("albums"), F.sum("tracks").alias("tracks"), F.count("*").alias("artists"), F.grouping("artist").alias("g"))
    return rolled.where("g = 0 or artists > 0").select(F.when(F.col("g") == 1, "all").otherwise("artist").alias("level"), "artist", "albums", "tracks", "artists")


def by_album(albums: DataFrame) -> DataFrame:
    """O3. All albums, case-insensitive by album, then artist; ties by the names themselves."""
    return albums.orderBy(F.lower("album"), F.lower("artist"), "artist", "album")


def markdown(albums: DataFrame) -> DataFrame:
    """S9, U3, O2. (section, k1, k2, line_no, line): report lines with their sort keys.

    ``orderBy(all but the last)`` is the report; it is a range sort, so long reports have
    many parts.
    """
    t = totals(albums)

    def rows(df: DataFrame, section: int, k1, k2, *lines) -> DataFrame:
        return df.select(F.lit(section).alias("section"), k1.alias("k1"), k2.alias("k2"), F.posexplode(F.array(*lines)).alias("line_no", "line"))

    none = F.lit("")
    whole = t.where("level = 'all'")
    counts = [F.concat(F.lit(f"**{name}**: "), F.col(c).cast("string")) for name, c in (("総アーティスト数", "artists"), ("総アルバム数", "albums"), ("総曲数", "tracks"))]
    head = rows(whole, 0, none, none, F.lit("# CD取り込み済みリスト"), none, *counts, none, F.lit("---"), none, F.lit("## アーティスト別一覧"), none)
    artists = t.where("level = 'artist'")
    title = F.format_string("### %s （全%d枚、%d曲）", "artist", "albums", "tracks")
    top = rows(artists, 1, F.col("artist"), none, title, none)
    each = rows(albums, 1, F.col("artist"), F.concat(F.lit("\x01"), F.col("album")), F.format_string("- %s （%d曲）", "album", "tracks"))
    end = rows(artists, 1, F.col("artist"), F.lit("\U0010ffff"), none)
    middle = rows(whole, 2, none, none, F.lit("---"), none, F.lit("## 全アルバム一覧（アルファベット順）"), none)
    flat = rows(albums, 3, F.concat_ws("\x01", F.lower("album"), F.lower("artist")), F.concat_ws("\x01", "artist", "album"), F.format_string("- **%s** （%d曲） / %s", "album", "tracks", "artist"))
    out = head
    for part in (top, each, end, middle, flat):
        out = out.unionByName(part)
    return out


def report(albums: DataFrame) -> DataFrame:
    """The report's lines in order."""
    return markdown(albums).orderBy("section", "k1", "k2", "line_no").select("line")


def write_report(albums: DataFrame, folder: str, name: str = "report.md", overwrite: bool = False) -> None:
    """S9. The report as one file: its lines in order, with a newline between them and none at the end."""
    first = (F.col("section") == 0) & (F.col("line_no") == 0)
    text = F.when(first, F.col("line")).otherwise(F.concat(F.lit("\n"), "line"))
    files.write_ordered(markdown(albums).withColumn("file", F.lit(name)).withColumn("text", text), ("section", "k1", "k2", "line_no"), folder, overwrite)
