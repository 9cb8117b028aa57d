"""From raw records to posts: field mapping, normalisation, rejection reasons, de-duplication, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X

# Under which names a field may come, the first non-empty one counts.
ALIASES = {
    "post_id": ("post_id", "id", "tweet_id", "id_str", "status_id"),
    "text": ("text", "content", "full_text", "body", "message", "tweet"),
    "created_at": ("created_at", "timestamp", "date", "publish_date", "time", "datetime"),
    "language": ("language", "lang"),
    "country": ("location.country", "country", "region", "user_location", "place.country"),
    "city": ("location.city", "city"),
    "user_id": ("user.user_id", "user.id", "user_id", "author_id"),
    "username": ("user.username", "user.screen_name", "username", "screen_name", "user", "author"),
    "followers": ("user.followers", "user.followers_count", "followers", "followers_count"),
    "following": ("user.following", "following", "friends_count"),
    "likes": ("likes", "like_count", "favorite_count", "favorites", "engagement.likes"),
    "comments": ("comments", "comment_count", "reply_count", "replies", "engagement.comments"),
    "shares": ("shares", "share_count", "retweet_count", "retweets", "engagement.shares"),
    "synthetic": ("engagement.synthetic",),
    "is_retweet": ("is_retweet", "retweet"),
    "hashtags": ("hashtags",),
}
# The raw CSV profile.
RAW_PROFILE = {
    "post_id": ("tweet_id",), "text": ("content",), "created_at": ("publish_date",), "language": ("language",), "country": ("region",), "city": (),
    "user_id": ("alt_external_id", "external_author_id"), "username": ("author",), "followers": ("followers",), "following": ("following",), "updates": ("updates",),
    "account_category": ("account_category",), "account_type": ("account_type",), "is_retweet": ("retweet",), "kind": ("post_type",),
}
PROFILES = {"generic": ALIASES, "raw": RAW_PROFILE}


def _fields(raw: DataFrame, profile: str) -> dict[str, Column]:
    """Each field as text: from the parsed record ``v`` (once parsed, looked up by path), or from the raw profile's own columns."""

    def at(path: str) -> Column:
        return F.try_variant_get(F.col("v"), f"$.{path}", "string") if "v" in raw.columns else F.col(path)

    def first(paths: tuple[str, ...]) -> Column:
        # an object isn't a value: 'user' is a name only where it is a text
        found = [at(p) for p in paths]
        return F.coalesce(*[F.when((v != "") & ~v.startswith("{"), v) for v in found], F.lit(None).cast("string"))

    names = {*ALIASES, *RAW_PROFILE}
    return {name: first(PROFILES[profile].get(name, ())) for name in names}


REASONS = ("parse_error", "missing_id", "empty_text", "invalid_timestamp")


def reason(post_id: Column, text: Column, created_at: Column, parse_error: Column) -> Column:
    """The first reason to reject a record, null for a valid one."""
    return F.when(parse_error, "parse_error").when(X.blank(post_id), "missing_id").when(X.blank(text), "empty_text").when(created_at.isNull(), "invalid_timestamp")


def normalise(raw: DataFrame, profile: str = "generic", source: str = "upload", job_id: str | None = None, now: str | None = None) -> DataFrame:
    """Rows of schema.POSTS_DDL with ``reason`` (null if valid), ``file_ord`` and ``row_ord``, from records as readers.read() gives them or the raw profile's columns."""
    f = _fields(raw, profile)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    d = raw.select("file_ord", "row_ord", "parse_error", *[c.alias(f"__{n}") for n, c in f.items()])
    c = lambda n: F.col(f"__{n}")
    d = d.withColumn("created", X.timestamp(c("created_at"), at, epoch=profile == "generic"))
    d = d.withColumn("reason", reason(c("post_id"), c("text"), F.col("created"), F.col("parse_error")))
    d = d.withColumn("body", X.unescape(F.coalesce(c("text"), F.lit(""))))
    given = F.filter(F.transform(F.coalesce(F.from_json(c("hashtags"), "array<string>"), F.array().cast("array<string>")), lambda t: X.strip(F.lower(F.regexp_replace(t, "^#+", "")))), lambda t: t != "")
    d = d.withColumn("clean", X.clean(F.col("body"))).withColumn("tags", F.array_distinct(F.concat(X.hashtags(F.col("body")), given)))
    d = d.withColumn("handles", X.mentions(F.col("body"))).withColumn("urls", X.url_count(F.col("body")))
    kind = F.upper(F.coalesce(X.strip(c("kind")), F.lit("")))
    flagged = F.coalesce(F.lower(X.strip(c("is_retweet"))).isin("1", "true"), F.lit(False)) | (kind == "RETWEET")
    kind = F.when((kind == "RETWEET") | (flagged if profile == "generic" else F.lit(False)), "retweet").when(kind == "QUOTE_TWEET", "quote").otherwise("original")
    number = {n: X.non_negative_int(c(n)) for n in ("followers", "following", "updates", "likes", "comments", "shares")}
    part = lambda n: F.coalesce(number[n], F.lit(0).cast("bigint")).alias(n)
    known = F.coalesce(c("likes"), c("comments"), c("shares")).isNotNull()
    total = (F.coalesce(number["likes"], F.lit(0)) + F.coalesce(number["comments"], F.lit(0)) + F.coalesce(number["shares"], F.lit(0))).cast("bigint")
    synthetic = F.coalesce(F.lower(c("synthetic")) == "true", F.lit(False))
    country, city = X.place(c("country")), X.place(c("city"))
    return d.select(
        X.strip(c("post_id")).alias("post_id"), F.lit(source).alias("source"),
        F.struct(X.strip(c("user_id")).alias("user_id"), F.coalesce(X.strip(c("username")), F.lit("unknown")).alias("username"), number["followers"].alias("followers"), number["following"].alias("following"), number["updates"].alias("updates"), c("account_category").alias("account_category"), c("account_type").alias("account_type")).alias("user"),
        c("text").alias("text"), F.col("clean").alias("clean_text"), F.col("created").alias("created_at"), X.language(c("language")).alias("language"),
        F.when(country.isNotNull() | city.isNotNull(), F.struct(country.alias("country"), city.alias("city"))).alias("location"),
        F.col("tags").alias("hashtags"), F.col("handles").alias("mentions"), F.col("urls").alias("url_count"), X.emojis(F.col("body")).alias("emojis"),
        kind.alias("post_type"), (flagged | X.is_retweet_text(F.col("body"))).alias("is_retweet"), number["followers"].alias("reach"),
        F.when(known, F.struct(part("likes"), part("comments"), part("shares"), total.alias("total"), synthetic.alias("synthetic"), F.lit(None).cast("string").alias("generator"))).alias("engagement"),
        F.lit(None).cast("struct<label: string, score: double, confidence: double, method: string>").alias("sentiment"),
        F.lit(None).cast("struct<id: string, label: string, weight: double, method: string>").alias("topic"),
        F.array().cast("array<string>").alias("keywords"), X.fingerprint(F.col("clean")).alias("text_hash"),
        X.quality_flags(F.col("clean"), F.col("tags"), F.col("handles"), F.col("urls")).alias("quality_flags"),
        F.lit(False).alias("processed"), at.alias("ingested_at"), F.lit(job_id).cast("string").alias("ingestion_job_id"), F.lit(None).cast("timestamp").alias("processed_at"),
        "reason", "file_ord", "row_ord",
    )


def first_of_each(posts: DataFrame, key: str = "post_id") -> DataFrame:
    """The first row of every id, by file and place in it."""
    w = Window.partitionBy(key).orderBy("file_ord", "row_ord")
    return posts.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def accepted(posts: DataFrame) -> DataFrame:
    return first_of_each(posts.where("reason is null")).drop("reason", "file_ord", "row_ord")


#: What cleaning found in an accepted post.
FOUND = {"with_hashtags": "size(hashtags) > 0", "with_urls": "url_count > 0", "retweets": "is_retweet", "without_language": "language is null", "flagged": "size(quality_flags) > 0"}


def folded(posts: DataFrame) -> DataFrame:
    """The first row of every id, with ``rows``, how many there were; rejected rows stay each by itself.

    Rows are folded before they are shuffled, so an id that a third of the input repeats is no hot spot.  ``fold_key`` is the id, or
    a rejected row's place.
    """
    alone = F.concat(F.lit("\0"), F.col("file_ord").cast("string"), F.lit(":"), F.col("row_ord").cast("string"))
    key = F.when(F.col("reason").isNull(), F.col("post_id")).otherwise(alone)
    g = posts.groupBy(key.alias("fold_key")).agg(F.min_by(F.struct(*posts.columns), F.struct("file_ord", "row_ord")).alias("first"), F.count("*").alias("rows"))
    return g.select("fold_key", "rows", "first.*")


def counted() -> dict[str, Column]:
    """The counters of folded rows, as columns to sum."""
    ok, rows = F.col("reason").isNull(), F.col("rows")
    own = {"read": rows, "rejected": F.when(~ok, rows), "accepted": ok.cast("bigint")} | {n: (ok & F.expr(sql)).cast("bigint") for n, sql in FOUND.items()}
    return own | {"duplicates": F.when(ok, rows - 1)} | {f"rejected_{r}": (F.col("reason") == r).cast("bigint") for r in REASONS}


def counters(posts: DataFrame) -> DataFrame:
    """One row: records read, rejected and accepted, and what cleaning found in the accepted ones."""
    return folded(posts).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in counted().items()])


def reasons(posts: DataFrame) -> DataFrame:
    return posts.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
