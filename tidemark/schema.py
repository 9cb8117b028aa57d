"""Schemas, sentinels and validation predicates of the posts model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the raw CSV profile (fixed values); bronze keeps them all as strings.
RAW_COLUMNS = (
    "external_author_id", "author", "content", "region", "language", "publish_date", "harvested_date",
    "following", "followers", "updates", "post_type", "account_type", "retweet", "account_category",
    "new_june_2018", "alt_external_id", "tweet_id", "article_url", "tco1_step1", "tco2_step1", "tco3_step1",
)
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

#: What a missing dimension is called in rollups and in filters (fixed values).
SENTINELS = {"language": "unknown", "country": "Unknown", "sentiment": "not_analyzed", "topic_id": "none"}
#: Columns that are looked up by value.
POINTS = ("post_id", "text_hash")
SENTIMENTS = ("positive", "neutral", "negative")

POSTS_DDL = """
    post_id string not null, source string,
    user struct<user_id: string, username: string, followers: bigint, following: bigint, updates: bigint, account_category: string, account_type: string>,
    text string, clean_text string, created_at timestamp, language string, location struct<country: string, city: string>,
    hashtags array<string>, mentions array<string>, url_count int, emojis array<string>,
    post_type string, is_retweet boolean, reach bigint,
    engagement struct<likes: bigint, comments: bigint, shares: bigint, total: bigint, synthetic: boolean, generator: string>,
    sentiment struct<label: string, score: double, confidence: double, method: string>,
    topic struct<id: string, label: string, weight: double, method: string>,
    keywords array<string>, text_hash string, quality_flags array<string>,
    processed boolean, ingested_at timestamp, ingestion_job_id string, processed_at timestamp
"""


def schema_violations() -> Column:
    """Names of the rules that a posts row breaks, an empty array for a valid row."""
    c = F.col
    rules = {
        "post_id": c("post_id").isNull() | (c("post_id") == ""),
        "source": c("source").isNull(),
        "username": c("user.username").isNull(),
        "text": c("text").isNull(),
        "created_at": c("created_at").isNull(),
        "post_type": ~F.coalesce(c("post_type").isin("original", "retweet", "quote"), F.lit(False)),
        "sentiment": ~F.coalesce(c("sentiment.label").isin(*SENTIMENTS), F.lit(True)),
        "reach": F.coalesce(c("reach") < 0, F.lit(False)),
        "url_count": F.coalesce(c("url_count") < 0, F.lit(False)),
        "engagement": F.coalesce(F.least("engagement.likes", "engagement.comments", "engagement.shares", "engagement.total") < 0, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def flat(posts):
    """The flat form that rollups and analytics read, from rows of POSTS_DDL."""
    c = F.col
    return posts.select(
        "post_id", "created_at", c("user.username").alias("username"), c("user.user_id").alias("user_id"),
        c("user.account_category").alias("account_category"), c("user.account_type").alias("account_type"),
        "language", c("location.country").alias("country"), c("sentiment.label").alias("sentiment"), c("sentiment.score").alias("score"),
        c("topic.id").alias("topic_id"), "hashtags", "keywords", "reach", c("user.followers").alias("followers"),
        c("engagement.likes").alias("likes"), c("engagement.comments").alias("comments"), c("engagement.shares").alias("shares"),
        c("engagement.total").alias("engagement"), c("engagement.synthetic").alias("engagement_synthetic"),
        "is_retweet", "processed", "clean_text", "text_hash",
    )
