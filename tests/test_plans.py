from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.fixtures import posts_fx
from tidemark.operators import analytics as A
from tidemark.operators import rollups as R
from tidemark.operators.anomalies import isolation_scores
from tidemark.plans import planner
from tidemark.plans.filters import Filters
from tidemark.streaming import refresh


def test_routing():
    assert planner.choose(Filters(language="en")) == "daily_cube"
    assert planner.choose(Filters(hashtag="#X", mode="cube")) == "posts"
    assert planner.choose(Filters(), "hour") == "posts"
    assert planner.choose(Filters(min_engagement=0)) == "posts" and planner.choose(Filters(min_engagement=0).of_cube()) == "daily_cube"
    assert planner.choose_hourly(Filters(language="en")) == "hourly_cube" and planner.choose_hourly(Filters(topic="en-01")) == "posts"
    assert planner.choose_hashtags(Filters(start=date(2024, 1, 1))) == "hashtag_daily" and planner.choose_hashtags(Filters(country="x")) == "posts"


def test_bad_filters():
    for bad in ({"mode": "x"}, {"sentiment": "happy"}, {"min_engagement": -1}, {"q": "x" * 201}):
        with pytest.raises(ValueError):
            Filters(**bad)


def test_rollups_conserve_posts(spark, sf_dir, tmp_path):
    posts = posts_fx(spark, sf_dir).cache()
    n = posts.where("processed").count()
    assert R.daily_cube(posts).agg(F.sum("posts")).first()[0] == n
    assert R.hourly_cube(posts).agg(F.sum("posts")).first()[0] == posts.count()
    root = str(tmp_path / "rollups")
    R.rebuild(posts, root)
    before = {name: spark.read.parquet(f"{root}/{name}").count() for name in R.BUILDERS}
    changed = posts.withColumn("language", F.when(F.to_date("created_at") == "2024-01-05", F.lit("xx")).otherwise(F.col("language")))
    R.refresh(changed, root, "2024-01-05", "2024-01-05")
    cube = spark.read.parquet(f"{root}/daily_cube")
    want = R.daily_cube(changed)
    key = ["day", "language", "country", "sentiment", "topic_id", "posts", "engagement"]
    assert cube.select(key).exceptAll(want.select(key)).count() == 0 and want.select(key).exceptAll(cube.select(key)).count() == 0
    assert before["users"] == spark.read.parquet(f"{root}/users").count()
    # a day that has lost its posts loses its partitions, its users what they had there
    gone = posts.where("to_date(created_at) <> '2024-01-06'")
    R.refresh(gone, root, "2024-01-06", "2024-01-06")
    for name in R.BUILDERS:
        assert name == "users" or spark.read.parquet(f"{root}/{name}").where("day = '2024-01-06'").isEmpty()
    users = lambda df: {(r["username"], r["posts"]) for r in df.select("username", "posts").collect()}
    assert users(spark.read.parquet(f"{root}/users")) == users(R.users(gone))
    t = planner.Tables.at(spark, posts, root)
    f = Filters(start=date(2024, 1, 5), end=date(2024, 1, 6))
    plan = A.timeseries(t, f)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "event_id" not in plan
    posts.unpersist()


def test_live_and_cube_agree(spark, sf_dir):
    t = planner.Tables(posts_fx(spark, sf_dir).where("processed"))
    for f in (Filters(), Filters(language="unknown"), Filters(country="Unknown", sentiment="not_analyzed"), Filters(topic="none", start=date(2024, 1, 3), end=date(2024, 1, 9))):
        a, b = (A.engagement(t, Filters(**{**f.__dict__, "mode": m})).first() for m in ("cube", "live"))
        assert a == b


def test_isolation_forest_finds_the_odd_one():
    x = np.random.default_rng(1).normal(size=(200, 3))
    x[17] = 9
    assert isolation_scores(x, trees=50).argmax() == 17


def test_stream_keeps_rollups_fresh(spark, sf_dir, tmp_path):
    posts = posts_fx(spark, sf_dir)
    src, table, root = (str(tmp_path / x) for x in ("in", "posts", "rollups"))
    posts.where("created_at < '2024-01-10'").write.parquet(table)
    R.rebuild(spark.read.parquet(table), root)
    posts.where("created_at >= '2024-01-08' and created_at < '2024-01-12'").write.parquet(src)
    refresh.keep_fresh(spark.readStream.schema(posts.schema).parquet(src), table, root, str(tmp_path / "cp")).awaitTermination()
    want = R.daily_cube(posts.where("created_at < '2024-01-12'")).agg(F.sum("posts"), F.count("*")).first()
    assert spark.read.parquet(f"{root}/daily_cube").agg(F.sum("posts"), F.count("*")).first() == want
    assert refresh.hourly_counts(spark.readStream.schema(posts.schema).parquet(src)).isStreaming


def test_cube_is_read_not_derived(spark, sf_dir):
    from tidemark import catalog

    t = catalog.tables(spark, sf_dir)
    live, cube = (A.sentiment_over_time(t, Filters(mode=m)) for m in ("live", "cube"))
    assert cube._jdf.queryExecution().toString().count("FileScan parquet") == 1 and all("/daily_cube/" in f for f in cube.inputFiles())
    assert any("events.parquet" in f for f in live.inputFiles())
    read = lambda df: df.sparkSession.read.parquet(*df.inputFiles()).count()
    assert read(cube) < t.posts.count()
    assert catalog.tables(spark, sf_dir).root == t.root
