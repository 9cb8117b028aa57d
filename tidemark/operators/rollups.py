"""Pre-aggregated tables: builders from posts to cells, and the incremental refresh by day.

Every builder is one partial-then-final aggregation; hot days or tags are combined before the shuffle.
daily_cube and keyword_daily hold processed posts only; the others hold all.  daily_cube's ``accounts`` and engagement_daily's
``sketch`` are sketches that any span of days unites; ``postings`` is the inverted index of search.py.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import search
from tidemark.schema import SENTINELS, SENTIMENTS
from tidemark.sources import sinks

CUBE_KEYS = ("day", "language", "country", "sentiment", "topic_id")
CUBE_MEASURES = ("posts", "retweets", "with_hashtags", "reach", "score_sum", "likes", "comments", "shares", "engagement")


def total(c: str | Column) -> Column:
    """A sum in which missing values count as 0, and an empty sum is 0."""
    return F.coalesce(F.sum(c), F.lit(0))


def named(dimension: str) -> Column:
    return F.coalesce(F.col(dimension), F.lit(SENTINELS[dimension])).alias(dimension)


def sentiment_counts() -> list[Column]:
    return [F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS]


def as_measures(posts: DataFrame) -> DataFrame:
    """Each post as a cell of its own: the cube's columns at row level, with the time kept as ``t``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return posts.select(
        F.to_date("created_at").alias("day"), F.col("created_at").alias("t"), *[named(d) for d in SENTINELS],
        F.lit(1).cast("bigint").alias("posts"), F.col("is_retweet").cast("bigint").alias("retweets"), (F.size("hashtags") > 0).cast("bigint").alias("with_hashtags"),
        zero("reach"), F.coalesce("score", F.lit(0.0)).alias("score_sum"), zero("likes"), zero("comments"), zero("shares"), zero("engagement"),
        F.coalesce("engagement_synthetic", F.lit(False)).alias("engagement_synthetic"), "user_id",
    )


def daily_cube(posts: DataFrame) -> DataFrame:
    cells = as_measures(posts.where("processed")).groupBy(*CUBE_KEYS)
    accounts = F.hll_sketch_agg("user_id", ACCOUNT_REGISTERS).alias("accounts")
    return cells.agg(*[F.sum(m).alias(m) for m in CUBE_MEASURES], F.bool_or("engagement_synthetic").alias("engagement_synthetic"), accounts)


def hourly_cube(posts: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour")
    return posts.groupBy(hour, named("language"), named("sentiment")).agg(F.count("*").alias("posts"), total("reach").alias("reach"), total("engagement").alias("engagement"))


def hashtag_daily(posts: DataFrame) -> DataFrame:
    x = posts.select(F.to_date("created_at").alias("day"), F.explode("hashtags").alias("hashtag"), "reach", "engagement", "sentiment")
    return x.groupBy("day", "hashtag").agg(F.count("*").alias("posts"), total("reach").alias("reach"), total("engagement").alias("engagement"), *sentiment_counts())


def keyword_daily(posts: DataFrame) -> DataFrame:
    """The language keeps its nulls here."""
    x = posts.where("processed").select(F.to_date("created_at").alias("day"), "language", F.explode("keywords").alias("keyword"), "reach")
    return x.groupBy("day", "language", "keyword").agg(F.count("*").alias("posts"), total("reach").alias("reach"))


def users(posts: DataFrame) -> DataFrame:
    """One row per username; identity columns come from its first post (by time, then id)."""
    first = lambda c: F.min_by(c, F.struct("created_at", "post_id")).alias(c)
    u = posts.groupBy("username").agg(
        first("user_id"), first("account_category"), first("account_type"),
        F.count("*").alias("posts"), F.count_if("is_retweet").alias("retweets"),
        F.min("created_at").alias("first_post"), F.max("created_at").alias("last_post"),
        F.max("followers").alias("max_followers"), F.round(F.avg("followers"), 0).alias("avg_followers"),
        F.array_sort(F.collect_set("language")).alias("languages"), total(F.size("hashtags")).alias("hashtag_uses"), *sentiment_counts(),
    )
    u = u.withColumn("active_days", (F.datediff("last_post", "first_post") + 1).cast("bigint"))
    u = u.withColumn("retweet_ratio", F.round(F.col("retweets") / F.col("posts"), 4))
    return u.withColumn("posts_per_active_day", F.round(F.col("posts") / F.col("active_days"), 2))


def engagement_daily(posts: DataFrame) -> DataFrame:
    """Engagement by day and language as mergeable quantile sketches; posts without engagement are left out."""
    x = posts.where("engagement is not null").select(F.to_date("created_at").alias("day"), named("language"), "engagement")
    return x.groupBy("day", "language").agg(F.count("*").alias("posts"), F.kll_sketch_agg_bigint("engagement", F.lit(QUANTILE_K)).alias("sketch"))


#: A quantile sketch's size: ranks are off by 0.4 % or so (one in a hundred by more), however many sketches are merged.
QUANTILE_K = 800
#: Registers (as a power of two) of a sketch of distinct accounts: a standard error of 1.6 % from some hundred accounts on, fewer are exact.
ACCOUNT_REGISTERS = 12

BUILDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "daily_cube": daily_cube, "hourly_cube": hourly_cube, "hashtag_daily": hashtag_daily, "keyword_daily": keyword_daily, "users": users,
    "engagement_daily": engagement_daily, "postings": search.postings, "text_daily": search.text_daily,
}
#: Partition columns other than the day, and the order inside a partition.
PARTITIONS = {"postings": ("day", "bucket")}
SORTED = {"postings": ("word",)}


def _with_day(name: str, df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.to_date("hour")) if name == "hourly_cube" else df


def stored(spark: SparkSession, name: str, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def _write(df: DataFrame, name: str, path: str) -> None:
    """Partitioned by the rollup's partition columns, a partition's rows in as few files as their size asks for."""
    by = PARTITIONS.get(name, ("day",))
    rows = _with_day(name, df).hint("rebalance", *by)
    if name in SORTED:
        rows = rows.sortWithinPartitions(*by, *SORTED[name])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def build(posts: DataFrame, name: str, root: str) -> None:
    """One rollup from all posts, in place of what is there."""
    if name == "users":
        sinks.rebuild(BUILDERS[name](posts), f"{root}/{name}")
    else:
        _write(BUILDERS[name](posts), name, f"{root}/{name}")


def published(posts: DataFrame, name: str, root: str) -> DataFrame:
    """One rollup under ``root``, built where it isn't there yet, and never written again: for posts that don't change."""
    spark = posts.sparkSession
    made = lambda to: BUILDERS[name](posts).write.parquet(to) if name == "users" else _write(BUILDERS[name](posts), name, to)
    return spark.read.parquet(sinks.publish(spark, f"{root}/{name}", made))


def rebuild(posts: DataFrame, root: str) -> None:
    """All rollups from all posts."""
    for name in BUILDERS:
        build(posts, name, root)


def refresh(posts: DataFrame, root: str, start: str, end: str, names: DataFrame | None = None) -> None:
    """refresh_days() of all days from ``start`` to ``end``."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    refresh_days(posts, root, [first + timedelta(days=i) for i in range((last - first).days + 1)], names)


def refresh_days(posts: DataFrame, root: str, days: list[date], names: DataFrame | None = None) -> None:
    """Recomputes whole days and replaces their partitions; a day that has lost all its posts loses its partition.

    Of the users only those in ``names`` (username) are recomputed where it is given, else those who posted in these days or had posts there.
    """
    if not days:
        return
    spark, at = posts.sparkSession, F.col("created_at")
    span = (at >= F.lit(min(days)).cast("timestamp")) & (at < F.date_add(F.lit(max(days)), 1).cast("timestamp"))  # for the files' statistics
    touched = posts.where(span & F.to_date("created_at").isin(days))
    for name, builder in BUILDERS.items():
        if name != "users":
            sinks.replace_partitions(builder(touched), f"{root}/{name}", PARTITIONS.get(name, ("day",)), F.col("day").isin(days), lambda df, to, n=name: _write(df, n, to))
    if not sinks.exists(spark, f"{root}/users"):
        build(posts, "users", root)
        return
    old = stored(spark, "users", root)
    if names is None:
        had = old.where((F.col("first_post") < F.date_add(F.lit(max(days)), 1)) & (F.col("last_post") >= F.lit(min(days)))).select("username")
        names = touched.select("username").union(had).distinct()
    new = users(posts.join(names, "username", "left_semi"))
    sinks.rebuild(old.join(names, "username", "left_anti").unionByName(new), f"{root}/users")


def touched_range(posts: DataFrame, job_id: str) -> DataFrame:
    """(first, last) creation time of a job's posts."""
    return posts.where(F.col("ingestion_job_id") == job_id).agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def touched_days(posts: DataFrame) -> list[date]:
    """The days of some posts, in order: those to refresh."""
    return sorted(r["day"] for r in posts.select(F.to_date("created_at").alias("day")).distinct().collect())  # a row per day
