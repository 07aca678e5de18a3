"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.shared import discard, materialize, shared_folder, spread

__all__ = ["SPACES", "discard", "hot_keys", "materialize", "remainder", "shared_folder", "sampled", "split_by_slots", "spread", "spread_join", "words"]

#: White space of the word definition: space and the controls U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % modulus, F.lit(-1)).cast("int")


def sampled(df: DataFrame, total: int, rows: int) -> DataFrame:
    """At most ``rows`` of the ``total`` rows of ``df``, those of the lowest hashes over all columns; never none of some.

    The same rows however ``df`` is partitioned. Of equal rows, which share a hash, as many are
    taken as is their share, one at least; they meet as counts, so copies make no large group.
    """
    if total <= rows:
        return df
    columns = [F.col(f"`{c}`") for c in df.columns]
    share = 1.25 * rows / total
    n = F.greatest(F.lit(1), F.round(F.count("*") * rows / total).cast("int")).alias("__n")
    while True:
        place = F.pmod(F.xxhash64(*columns), F.lit(1 << 30))
        few = materialize(df.where(place < F.lit(int(share * (1 << 30)) + 1)).groupBy(*columns).agg(n), "sample")
        if share >= 1 or (few.agg(F.sum("__n")).first()[0] or 0) >= rows // 2:
            break
        discard(few)
        share *= 4
    each = few.withColumn("__k", F.explode(F.sequence(F.lit(1), "__n")))
    return each.orderBy(F.xxhash64(*columns), *columns).limit(rows).select(*columns)


#: Slots of the fixed-size filter in :func:`split_by_slots`.
SLOTS = 1 << 20


def split_by_slots(rows: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may have a key of ``wanted``, rows that surely have none).

    Keys are hashed to SLOTS slots; the slots in use, at most SLOTS rows whatever the data,
    go along with the tasks. So only the first part has to be shuffled for a join. Where
    nearly all slots are in use it is all rows, and the join is as it would be without.
    """
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS)).cast("int")
    used = F.broadcast(wanted.select(slot.alias("__slot")).distinct())
    marked = rows.withColumn("__slot", slot)
    return marked.join(used, "__slot", "left_semi").drop("__slot"), marked.join(used, "__slot", "left_anti").drop("__slot")


#: A key with more than one in HOT_KEYS of all rows is hot; so there are fewer than HOT_KEYS such keys.
HOT_KEYS = 2048


def hot_keys(counted: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """The keys of ``counted`` (keys, n) that hold more than one in HOT_KEYS of ``total`` rows."""
    return materialize(counted.where(F.col(n) * HOT_KEYS > total).select(*keys), "hot")


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has each key once; rows of ``hot`` keys stay where they are.

    The part of the table with those keys, fewer than HOT_KEYS rows, goes along with the
    tasks; the other rows are shuffled. ``how``: inner, left, left_semi or left_anti.
    """
    few = F.broadcast(hot)
    cold = rows.join(few, keys, "left_anti").join(table.hint("merge"), keys, how)
    warm = rows.join(few, keys, "left_semi").join(F.broadcast(table.join(few, keys, "left_semi")), keys, how)
    return cold.unionByName(warm)


def words(text: str | Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    column = F.col(text) if isinstance(text, str) else text
    spaced = F.translate(F.coalesce(column, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " "), lambda w: w != "")
