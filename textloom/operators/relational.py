"""Relational query over users, posts and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def posts_with_tags(users: DataFrame, posts: DataFrame, tags: DataFrame, post_tags: DataFrame, dedup_tags: bool = False) -> DataFrame:
    """J1-J3, P11, P12. (user_id, user_name, post_id, tag_id, tag_name, is_hoge).

    Inner join of posts, left joins of bridge and tags. The bridge is in the derived tag
    table too, so a tag that k posts have comes k times; ``dedup_tags`` takes each once.
    Shuffles on user_id, post id and tag id; AQE splits hot tags. is_hoge compares id and
    name as strings: the name where they are equal or differ, null where there is no tag.
    """
    used = tags.join(post_tags.select(F.col("tag_id").alias("id")), "id", "left_semi" if dedup_tags else "inner").select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"))
    found = (
        users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
        .join(posts.select(F.col("id").alias("post_id"), "user_id"), "user_id")
        .join(post_tags.select("post_id", "tag_id"), "post_id", "left")
        .join(used, "tag_id", "left")
    )
    return _shown(found)


def _shown(found: DataFrame) -> DataFrame:
    tag, name = F.col("tag_id").cast("string"), F.col("tag_name").cast("string")
    case = F.when(tag == name, tag).when(tag != name, name).otherwise(F.lit(None).cast("string"))
    return found.select("user_id", "user_name", "post_id", F.when(F.col("tag_name").isNotNull(), F.col("tag_id")).alias("tag_id"), "tag_name", case.alias("is_hoge"))


def store(users: DataFrame, posts: DataFrame, tags: DataFrame, post_tags: DataFrame, name: str, buckets: int = 64) -> None:
    """Tables ``<name>_users``, ``_posts`` and ``_bridge`` in buckets of user_id, ``_tags`` with its number of uses.

    The bridge gets the user of its post when it is written, so what belongs to a user lies in
    one bucket and :func:`stored_posts_with_tags` moves no row of the three tables. A user is in
    one bucket whole: choose ``buckets`` by the size of the tables.
    """

    def save(df: DataFrame, part: str, *order: str) -> None:
        df.repartition(buckets, "user_id").sortWithinPartitions("user_id", *order).write.mode("overwrite").bucketBy(buckets, "user_id").sortBy("user_id", *order).saveAsTable(f"{name}_{part}")

    save(users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name")), "users")
    by_post = posts.select(F.col("id").alias("post_id"), "user_id")
    save(by_post, "posts", "post_id")
    save(post_tags.select("post_id", "tag_id").join(by_post.distinct(), "post_id"), "bridge", "post_id")
    used = post_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("uses"))
    tags.join(used, "id").select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name"), "uses").write.mode("overwrite").saveAsTable(f"{name}_tags")


def stored_posts_with_tags(spark: SparkSession, name: str, dedup_tags: bool = False) -> DataFrame:
    """The rows of :func:`posts_with_tags` from the tables of :func:`store`.

    J1 and J2 are merge joins of buckets without a shuffle. J3 meets each tag once, and its uses
    multiply the row behind the join.
    """
    # a join by user and post may use the layout by user alone
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    users, posts, bridge, tags = (spark.table(f"{name}_{part}") for part in ("users", "posts", "bridge", "tags"))
    found = users.hint("merge").join(posts.hint("merge"), "user_id").join(bridge.hint("merge"), ["user_id", "post_id"], "left").join(tags, "tag_id", "left")
    if not dedup_tags:
        found = found.withColumn("__use", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("uses", F.lit(1).cast("long")))))
    return _shown(found)


def drop_stored(spark: SparkSession, name: str) -> None:
    for part in ("users", "posts", "bridge", "tags"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")


def ordered(df: DataFrame) -> DataFrame:
    """O1. By user, with the other ids as tie-breakers."""
    return df.orderBy("user_id", "post_id", "tag_id")
