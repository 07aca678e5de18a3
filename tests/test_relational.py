"""The relational query over bucketed tables: the same rows, and no shuffle of the big tables."""

import random
from collections import Counter

import pytest

from textloom.operators import relational


@pytest.fixture
def blog(spark):
    rng = random.Random(8)
    users = spark.createDataFrame([(k, f"user {k % 7}") for k in range(60)], "id int, name string")
    posts = spark.createDataFrame([(k, rng.choice([3, 3, 3, rng.randrange(70)])) for k in range(300)] + [(400, None)], "id int, user_id int")
    tags = spark.createDataFrame([(k, str(k) if k % 3 else f"tag {k}") for k in range(20)], "id int, name string")
    bridge = spark.createDataFrame([(rng.randrange(320), rng.choice([1, rng.randrange(25)])) for _ in range(500)] + [(None, 3), (5, None)], "post_id int, tag_id int")
    return users, posts, tags, bridge


@pytest.mark.parametrize("dedup", [True, False])
def test_stored_tables_give_the_same_rows(spark, blog, dedup):
    relational.store(*blog, "t_blog", 8)
    got = relational.stored_posts_with_tags(spark, "t_blog", dedup)
    want = relational.posts_with_tags(*blog, dedup_tags=dedup)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 500
    relational.drop_stored(spark, "t_blog")


def test_big_joins_do_not_shuffle(spark, blog):
    relational.store(*blog, "p_blog", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = relational.stored_posts_with_tags(spark, "p_blog")
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins, shuffles = plan.count("SortMergeJoin ["), [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
        assert joins == 3 and len(shuffles) == 2 and all("tag_id" in x and "user_id" not in x for x in shuffles), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        relational.drop_stored(spark, "p_blog")
