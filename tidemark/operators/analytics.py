"""The dashboard's questions as functions from tables and filters to DataFrames in long form.

Each reads the source that the planner chooses.  Ratios are rounded half up; every order has a tie key.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indexes, search
from tidemark.operators.rollups import ACCOUNT_REGISTERS, CUBE_MEASURES, QUANTILE_K, named, sentiment_counts, total
from tidemark.operators.search import hits
from tidemark.plans import planner
from tidemark.plans.filters import Filters, on_cube, on_posts
from tidemark.plans.planner import Tables
from tidemark.schema import SENTIMENTS, SENTINELS

NONE = SENTINELS["topic_id"]
SPLITS = {"sentiment": "sentiment", "topic": "topic_id", "language": "language", "country": "country"}


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent, 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / whole, digits))


def ratio(a: Column, b: Column, digits: int, instead: float | None = None) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b), digits), F.lit(instead).cast("double"))


def is_topic(c: str = "topic_id") -> Column:
    """A topic proper: not missing and not a language's rest."""
    return F.col(c).isNotNull() & (F.col(c) != NONE) & ~F.col(c).endswith("-other")


def bucket(granularity: str) -> Column:
    if granularity not in ("hour", "day", "week", "month"):
        raise ValueError(f"unknown granularity {granularity!r}")
    return F.date_trunc(granularity, "t").cast("timestamp_ntz")


def sums(*measures: str) -> list[Column]:
    return [total(m).alias(m) for m in measures]


def _of(s: str) -> Column:
    return total(F.when(F.col("sentiment") == s, F.col("posts"))).alias(s)


def _sentiment_sums() -> list[Column]:
    return [*[_of(s) for s in SENTIMENTS], total(F.when(F.col("sentiment") != SENTINELS["sentiment"], F.col("posts"))).alias("analysed")]


def with_labels(df: DataFrame, t: Tables, key: str = "topic_id") -> DataFrame:
    """df with the topics' labels, a topic's id where it has none."""
    if t.topics is None:
        return df.withColumn("label", F.col(key))
    topics = t.topics.select(F.col("topic_id").alias("__id"), F.col("label").alias("__label"))
    return df.join(topics, F.col(key) == F.col("__id"), "left").withColumn("label", F.coalesce("__label", key)).drop("__id", "__label")


# -- overview, series, activity


def active_end(t: Tables, quantile: float = 0.99) -> DataFrame:
    """The first day by which ``quantile`` of all posts had appeared (one row)."""
    days = t.rollup("daily_cube").groupBy("day").agg(F.sum("posts").alias("posts"))
    everything = Window.partitionBy()
    run = F.sum("posts").over(everything.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    d = days.select("day", run.alias("run"), F.sum("posts").over(everything).alias("total"))
    return d.agg(F.min(F.when(F.col("run") >= F.col("total") * quantile, F.col("day"))).alias("active_end"))


def dataset_bounds(t: Tables) -> DataFrame:
    return t.posts.agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def overview(t: Tables, f: Filters = Filters()) -> DataFrame:
    """One row of totals; users and rising hashtags depend on the dates alone."""
    m = planner.cells(t, f)
    o = m.agg(
        *sums("posts", "retweets", "reach", "engagement"), *_sentiment_sums(), F.sum("score_sum").alias("score_sum"),
        F.countDistinct(F.when(is_topic(), F.col("topic_id"))).alias("topics"), F.countDistinct("language").alias("languages"), F.countDistinct("country").alias("countries"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )
    rising = trends(t, "hashtag", end=f.end, window_days=7, limit=1000, min_count=10).where("growth_pct > 0").agg(F.count("*").alias("trending_hashtags"))
    people = t.rollup("users").agg(F.count("*").alias("users"))
    o = o.crossJoin(rising).crossJoin(people)  # one row each
    return o.select(
        "posts", "retweets", "reach", "engagement", "analysed", *SENTIMENTS, *[pct(F.col(s), F.col("analysed")).alias(f"{s}_pct") for s in SENTIMENTS],
        ratio(F.col("score_sum"), F.col("analysed"), 4).alias("avg_score"), "topics", "languages", "countries", "first_day", "last_day", "users", "trending_hashtags",
    )


def timeseries(t: Tables, f: Filters = Filters(), granularity: str = "day", split_by: str | None = None) -> DataFrame:
    keys = [bucket(granularity).alias("t")] + ([F.col(SPLITS[split_by]).alias("series")] if split_by else [])
    order = ["t", "series"] if split_by else ["t"]
    return planner.cells(t, f, granularity).groupBy(*keys).agg(*sums("posts", "reach", "engagement")).orderBy(*order)


def wide(series: DataFrame, value: str = "posts", names: list[str] | None = None) -> DataFrame:
    """A split series with a column per series; give ``names`` to spare Spark a pass over the data."""
    return series.groupBy("t").pivot("series", names).agg(F.sum(value)).orderBy("t")


def activity(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Posts by ISO weekday (1 is Monday) and hour."""
    if planner.choose_hourly(f) == "posts":
        x = t.posts.where(on_posts(f)).select(F.col("created_at").alias("hour"), F.lit(1).alias("posts"))
    else:
        x = t.rollup("hourly_cube").withColumn("day", F.to_date("hour")).where(on_cube(f))
    return x.groupBy((F.weekday("hour") + 1).alias("weekday"), F.hour("hour").alias("hour")).agg(F.sum("posts").alias("posts")).orderBy("weekday", "hour")


# -- sentiment


def _with_shares(df: DataFrame) -> DataFrame:
    a = F.col("analysed")
    df = df.withColumns({f"{s}_pct": pct(F.col(s), a) for s in SENTIMENTS})
    return df.withColumn("net", ratio(F.col("positive") - F.col("negative"), a, 4)).withColumn("avg_score", ratio(F.col("score_sum"), a, 4)).drop("score_sum")


def sentiment_distribution(t: Tables, f: Filters = Filters()) -> DataFrame:
    m = planner.cells(t, f).groupBy("sentiment").agg(*sums("posts", "score_sum"))
    known = F.when(F.col("sentiment") != SENTINELS["sentiment"], F.col("posts"))
    return m.withColumn("pct", F.when(known.isNotNull(), pct(F.col("posts"), F.sum(known).over(Window.partitionBy())))).drop("score_sum")


def sentiment_over_time(t: Tables, f: Filters = Filters(), granularity: str = "week") -> DataFrame:
    """Buckets without analysed posts are left out; shares need at least 100."""
    m = planner.cells(t, f, granularity).groupBy(bucket(granularity).alias("t")).agg(*sums("posts", "score_sum"), *_sentiment_sums())
    m = _with_shares(m.where("analysed > 0"))
    return m.withColumns({f"{s}_pct": F.when(F.col("analysed") >= 100, F.col(f"{s}_pct")) for s in SENTIMENTS}).orderBy("t")


def sentiment_by(t: Tables, dimension: str, f: Filters = Filters()) -> DataFrame:
    """By topic (30 at most), language (20) or country (30, with 100 analysed or more)."""
    column, least, most = {"topic": ("topic_id", 1, 30), "language": ("language", 1, 20), "country": ("country", 100, 30)}[dimension]
    m = planner.cells(t, f)
    m = m.where(is_topic()) if dimension == "topic" else m
    m = m.groupBy(column).agg(*sums("posts", "score_sum"), *_sentiment_sums()).where(F.col("analysed") >= least)
    m = _with_shares(m).orderBy(F.desc("analysed"), column).limit(most)
    return with_labels(m, t) if dimension == "topic" else m


# -- topics, trends


def topics(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Share, engagement and 30-day growth; '-other' buckets are listed, missing topics only on request."""
    m = planner.cells(t, f)
    m = m if f.topic else m.where(F.col("topic_id") != NONE)
    m = m.groupBy("topic_id").agg(*sums("posts", "reach", "engagement"))
    m = m.withColumn("share_pct", pct(F.col("posts"), F.sum("posts").over(Window.partitionBy()))).withColumn("avg_engagement", ratio(F.col("engagement"), F.col("posts"), 2, 0.0))
    growth = trends(t, "topic", end=f.end, window_days=30, limit=1000, min_count=1).select(F.col("key").alias("__key"), "growth_pct", "trend_score")
    m = m.join(growth, F.col("topic_id") == F.col("__key"), "left").drop("__key")
    return with_labels(m, t).orderBy(F.desc("posts"), "topic_id")


def topic_timeline(t: Tables, f: Filters = Filters(), granularity: str = "week", top: int = 8) -> DataFrame:
    m = planner.cells(t, f, granularity).where(is_topic())
    best = m.groupBy("topic_id").agg(F.sum("posts").alias("n")).orderBy(F.desc("n"), "topic_id").limit(top)
    return m.join(best, "topic_id", "left_semi").groupBy(bucket(granularity).alias("t"), "topic_id").agg(F.sum("posts").alias("posts")).orderBy("t", "topic_id")


def _keyed(t: Tables, kind: str, language: str | None) -> DataFrame:
    """(day, key, posts, reach) of the trend's kind."""
    if kind == "hashtag":
        return t.rollup("hashtag_daily").select("day", F.col("hashtag").alias("key"), "posts", "reach")
    if kind == "keyword":
        x = t.rollup("keyword_daily")
        key = "keyword"
    elif kind == "topic":
        x, key = t.rollup("daily_cube").where(F.col("topic_id") != NONE), "topic_id"
    else:
        raise ValueError(f"unknown trend kind {kind!r}")
    return (x.where(F.col("language") == language) if language else x).select("day", F.col(key).alias("key"), "posts", "reach")


def trends(t: Tables, kind: str = "hashtag", end: date | None = None, window_days: int = 7, limit: int = 20, min_count: int = 20, language: str | None = None, smoothing: float = 5.0) -> DataFrame:
    """The window up to ``end`` (by default the active end) against the one before it."""
    days = active_end(t).withColumnRenamed("active_end", "__end") if end is None else t.posts.sparkSession.range(1).select(F.lit(end).alias("__end"))
    now = (F.col("day") <= F.col("__end")) & (F.col("day") > F.date_sub("__end", window_days))
    then = (F.col("day") <= F.date_sub("__end", window_days)) & (F.col("day") > F.date_sub("__end", 2 * window_days))
    split = lambda: [total(F.when(now, F.col("posts"))).alias("current"), total(F.when(then, F.col("posts"))).alias("previous")]
    within = lambda df: df.crossJoin(F.broadcast(days)).where(now | then) if end is None else df.where((F.col("day") <= F.lit(end)) & (F.col("day") > F.lit(end - timedelta(days=2 * window_days)))).withColumn("__end", F.lit(end))
    g = within(_keyed(t, kind, language)).groupBy("key").agg(*split(), total(F.when(now, F.col("reach"))).alias("reach")).where(F.col("current") >= min_count)
    whole = within(t.rollup("daily_cube").select("day", "posts")).agg(*split()).select(F.col("current").alias("C"), F.col("previous").alias("P"))
    g = g.crossJoin(F.broadcast(whole))  # one row
    c, p, reach = (F.col(x).cast("double") for x in ("current", "previous", "reach"))
    score = F.log10(1 + c) * F.log2((c + smoothing) / (p + smoothing)) * (1 + 0.1 * F.log10(1 + reach / c))
    shares = 100 * ((c / F.col("C")) / (F.greatest(p, F.lit(1.0)) / F.col("P")) - 1)
    return g.select(
        "key", "current", "previous", "reach", F.round(100.0 * (c - p) / F.greatest(p, F.lit(1.0)), 1).alias("growth_pct"), F.round(score, 3).alias("trend_score"),
        F.when((F.col("C") > 0) & (F.col("P") > 0), F.round(shares, 1)).alias("share_growth_pct"),
        F.when((F.col("C") > 0) & (F.col("P") > 0), (F.col("C") > 3 * F.col("P")) | (3 * F.col("C") < F.col("P"))).otherwise(F.lit(True)).alias("uneven_windows"),
    ).orderBy(F.desc("trend_score"), "key").limit(limit)


def trend_timeline(t: Tables, kind: str, end: date, window_days: int = 7, top: int = 8, min_count: int = 20, language: str | None = None) -> DataFrame:
    """Daily counts of the leading keys over eight windows."""
    keys = trends(t, kind, end, window_days, top, min_count, language).select("key")
    x = _keyed(t, kind, language).where((F.col("day") <= F.lit(end)) & (F.col("day") > F.lit(end - timedelta(days=8 * window_days))))
    return x.join(F.broadcast(keys), "key", "left_semi").groupBy("day", "key").agg(F.sum("posts").alias("posts")).orderBy("day", "key")


def top_hashtags(t: Tables, f: Filters = Filters(), limit: int = 20) -> DataFrame:
    if planner.choose_hashtags(f) == "posts":
        x = t.posts.where(on_posts(f)).select(F.explode("hashtags").alias("hashtag"), "reach", "engagement", "sentiment")
        g = x.groupBy("hashtag").agg(F.count("*").alias("posts"), *sums("reach", "engagement"), *sentiment_counts())
    else:
        g = t.rollup("hashtag_daily").where(on_cube(f)).groupBy("hashtag").agg(*sums("posts", "reach", "engagement", *SENTIMENTS))
    return g.orderBy(F.desc("posts"), "hashtag").limit(limit)


# -- engagement, geography, languages, users


def _with_engagement(df: DataFrame) -> DataFrame:
    df = df.withColumn("avg_engagement", ratio(F.col("engagement"), F.col("posts"), 2, 0.0))
    return df.withColumn("per_1k_reach", F.round(F.try_divide(1000.0 * F.col("engagement"), F.col("reach")), 3))


def engagement(t: Tables, f: Filters = Filters(), by: str | None = None, granularity: str = "week") -> DataFrame:
    """Totals, or by ``time``, ``sentiment`` or ``topic`` (25 at most)."""
    m, measures = planner.cells(t, f, granularity if by == "time" else None), sums("posts", "reach", "likes", "comments", "shares", "engagement")
    if by is None:
        return _with_engagement(m.agg(*measures))
    if by == "time":
        return _with_engagement(m.groupBy(bucket(granularity).alias("t")).agg(*measures)).orderBy("t")
    if by == "sentiment":
        return _with_engagement(m.groupBy("sentiment").agg(*measures)).orderBy("sentiment")
    g = m.where(F.col("topic_id") != NONE).groupBy("topic_id").agg(*measures)
    return with_labels(_with_engagement(g.orderBy(F.desc("engagement"), "topic_id").limit(25)), t)


def top_posts(t: Tables, f: Filters = Filters(), limit: int = 10) -> DataFrame:
    p = t.posts.where(on_posts(f)).where("engagement >= 0")
    return p.select("post_id", "created_at", "username", "language", "topic_id", "engagement").orderBy(F.desc("engagement"), "post_id").limit(limit)


def _top_within(m: DataFrame, key: str, k: int) -> DataFrame:
    """Per key its k leading topics as one string, 'topic:posts' joined by commas."""
    g = m.where(is_topic()).groupBy(key, "topic_id").agg(F.sum("posts").alias("n"))
    g = g.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "topic_id"))).where(F.col("place") <= k)
    items = F.array_sort(F.collect_list(F.struct("place", F.concat_ws(":", "topic_id", "n").alias("item"))))
    return g.groupBy(F.col(key).alias("__key")).agg(F.array_join(F.transform(items, lambda x: x["item"]), ",").alias("top_topics"))


def geography(t: Tables, f: Filters = Filters()) -> DataFrame:
    m = planner.cells(t, f)
    g = _with_engagement(m.groupBy("country").agg(*sums("posts", "reach", "score_sum", "engagement"), *_sentiment_sums()))
    g = _with_shares(g).withColumn("coverage_pct", pct(F.sum(F.when(F.col("country") != SENTINELS["country"], F.col("posts"))).over(Window.partitionBy()), F.sum("posts").over(Window.partitionBy())))
    return g.join(_top_within(m, "country", 3), F.col("country") == F.col("__key"), "left").drop("__key").orderBy(F.desc("posts"), "country")


def languages(t: Tables, f: Filters = Filters()) -> DataFrame:
    m = planner.cells(t, f)
    g = _with_shares(m.groupBy("language").agg(*sums("posts", "reach", "score_sum", "engagement"), *_sentiment_sums()))
    g = g.withColumn("share_pct", pct(F.col("posts"), F.sum("posts").over(Window.partitionBy())))
    return g.join(_top_within(m, "language", 5), F.col("language") == F.col("__key"), "left").drop("__key").orderBy(F.desc("posts"), "language")


def top_users(t: Tables, category: str | None = None, limit: int = 20) -> DataFrame:
    u = t.rollup("users")
    u = u.where(F.col("account_category") == category) if category else u
    return u.orderBy(F.desc("posts"), "username").limit(limit)


def category_stats(t: Tables) -> DataFrame:
    g = t.rollup("users").groupBy("account_category").agg(
        F.count("*").alias("accounts"), *sums("posts", *SENTIMENTS), F.avg("retweet_ratio").alias("r"), F.avg("posts_per_active_day").alias("a"))
    return g.select("account_category", "accounts", "posts", *SENTIMENTS, F.coalesce(F.round("r", 4), F.lit(0.0)).alias("avg_retweet_ratio"), F.coalesce(F.round("a", 2), F.lit(0.0)).alias("avg_posts_per_day")).orderBy(F.desc("posts"), "account_category")


# -- posts


def list_posts(t: Tables, f: Filters = Filters(), sort: str = "newest", page: int = 1, size: int = 20) -> DataFrame:
    """A page of posts.  Relevance is the number of matching words; without ``q`` it is newest."""
    if not (1 <= page <= 400 and 1 <= size <= 100):
        raise ValueError("page is 1 to 400, size 1 to 100")
    newest = [F.desc("created_at"), F.desc("post_id")]
    order = {"newest": newest, "oldest": [F.asc("created_at"), F.asc("post_id")], "engagement": [F.desc_nulls_last("engagement"), *newest], "relevance": [F.desc("relevance"), *newest]}[sort]
    rest = replace(f, q=None)
    if f.q and t.by_text and f.mode != "live":
        p = _with_relevance(t, f)
    elif f.q and t.indexed and f.mode != "live":
        found = search.found(t.rollup("postings"), f.q, f.start, f.end)
        if sort != "engagement" and not rest.more_than_dates:  # the index alone knows the page: a page's rows at most meet the posts
            found = F.broadcast(found.orderBy(*order).limit(page * size))
        p = t.posts.where(on_posts(rest)).join(found.select("post_id", "relevance"), "post_id")
    else:
        # with ``q`` the words are counted once, for the filter and for the order
        p = t.posts.where(on_posts(rest)).withColumn("relevance", hits(F.col("clean_text"), f.q) if f.q else F.lit(0))
        p = p.where("relevance > 0") if f.q else p
    p = p.orderBy(*order).offset((page - 1) * size).limit(size)
    return with_labels(p.select("post_id", "created_at", "username", "language", "country", "sentiment", "topic_id", "engagement", "is_retweet", "relevance"), t)


def _with_relevance(t: Tables, f: Filters) -> DataFrame:
    """The posts that a search finds, by the index of texts; no text is read."""
    found = search.found_texts(t.text_postings(), t.stored_texts(), f.q)
    return t.by_time().where(on_posts(replace(f, q=None))).join(found, "text_hash")


def count_posts(t: Tables, f: Filters = Filters(), cap: int = 100_000) -> DataFrame:
    """The number of matching posts, counted up to ``cap`` only."""
    only_words = f.q and t.indexed and f.mode != "live" and not replace(f, q=None).more_than_dates
    if f.q and t.by_text and f.mode != "live":
        p = _with_relevance(t, f)
    else:
        p = search.found(t.rollup("postings"), f.q, f.start, f.end) if only_words else t.posts.where(on_posts(f))
    narrowed = f.more_than_dates or bool(f.start or f.end)
    n = (p.select("post_id").limit(cap) if narrowed else p).agg(F.count("*").alias("total"))
    return n.withColumn("total_capped", F.lit(narrowed) & (F.col("total") == cap))


def get_post(t: Tables, post_id: str) -> DataFrame:
    """The post with the number of posts (itself included) with its text: two lookups by value, of the id and of the text's fingerprint."""
    posts = t.by_time()
    post = indexes.one(posts, post_id)
    hashes = [r["text_hash"] for r in post.select("text_hash").limit(1).collect()]
    same = indexes.same_text(posts, hashes[0]).agg(F.count("*")).first()[0] if hashes and hashes[0] else len(hashes)
    if t.by_text:
        text = indexes.same_text(t.stored_texts(), hashes[0] if hashes else None).select(F.col("text_hash").alias("__hash"), "clean_text")
        post = post.join(F.broadcast(text), F.col("text_hash") == F.col("__hash"), "left").drop("__hash")  # a row at most
    return post.withColumn("identical_texts", F.lit(same).cast("bigint"))


def best_posts(t: Tables, q: str, k: int = 20, start: date | None = None, end: date | None = None) -> DataFrame:
    """The k posts that answer a query best, by the index's scores."""
    if t.by_text:
        return search.ranked_texts(t.text_postings(), t.stored_texts(), t.by_time().where(on_posts(Filters(start=start, end=end))), q, k)
    return search.ranked(t.rollup("postings"), t.rollup("text_daily"), q, k, start, end)


def active_accounts(t: Tables, f: Filters = Filters(), granularity: str = "week") -> DataFrame:
    """(t, active_accounts): about how many accounts posted, from the cube's sketches united over each span (3 standard errors: 5 %)."""
    if planner.choose(f, granularity) == "posts":
        made = t.posts.where(on_posts(f)).groupBy(F.date_trunc(granularity, "created_at").cast("timestamp_ntz").alias("t")).agg(F.hll_sketch_agg("user_id", ACCOUNT_REGISTERS).alias("s"))
    else:
        made = planner.cells(t, f).groupBy(F.date_trunc(granularity, "t").cast("timestamp_ntz").alias("t")).agg(F.hll_union_agg("accounts").alias("s"))
    return made.select("t", F.hll_sketch_estimate("s").alias("active_accounts"))


def engagement_quantiles(t: Tables, shares: tuple[float, ...], f: Filters = Filters(), by: str | None = None) -> DataFrame:
    """(by, posts, share, value): the engagement below which a share of the posts lies, within 1 % of the rank, from the days' sketches united.

    For dates and language; other filters read the posts.  Terciles and the fences of outliers are shares like any other.
    """
    if f.mode == "live" or f.live_only or f.country or f.sentiment or f.topic:
        kept = t.posts.where(on_posts(f) & F.col("engagement").isNotNull()).select(F.to_date("created_at").alias("day"), named("language"), "engagement")
        g = kept.groupBy(*([by] if by else [])).agg(F.count("*").alias("posts"), F.kll_sketch_agg_bigint("engagement", F.lit(QUANTILE_K)).alias("sketch"))
    else:
        cells = t.rollup("engagement_daily").where(on_cube(Filters(start=f.start, end=f.end, language=f.language)))
        g = cells.groupBy(*([by] if by else [])).agg(F.sum("posts").alias("posts"), F.kll_merge_agg_bigint("sketch", F.lit(QUANTILE_K)).alias("sketch"))
    told = [F.struct(F.lit(x).alias("share"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(x)).alias("value")) for x in shares]
    return g.where("posts > 0").select(*([by] if by else []), "posts", F.inline(F.array(*told)))


def identical_texts(posts: DataFrame) -> DataFrame:
    """Every post with how many have its text."""
    n = posts.groupBy("text_hash").agg(F.count("*").alias("identical_texts"))
    return posts.select("post_id", "text_hash").join(n, "text_hash", "left")


def filter_options(t: Tables) -> DataFrame:
    """(kind, value, posts) of the languages, countries and topics that can be asked for."""
    cube = t.rollup("daily_cube")
    parts = [cube.groupBy(F.col(c).alias("value")).agg(F.sum("posts").alias("posts")).select(F.lit(kind).alias("kind"), "value", "posts") for kind, c in (("language", "language"), ("country", "country"), ("topic", "topic_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("kind", F.desc("posts"), "value")


def facets(t: Tables, f: Filters = Filters()) -> DataFrame:
    """Counts by language, by sentiment and in all, from one scan with grouping sets."""
    m = planner.cells(t, f)
    g = m.groupingSets([[F.col("language")], [F.col("sentiment")], []], F.col("language"), F.col("sentiment"))
    return g.agg(F.grouping("language").cast("int").alias("all_languages"), F.grouping("sentiment").cast("int").alias("all_sentiments"), *sums("posts", "reach"))


def country_engagement(t: Tables, k: int = 50) -> DataFrame:
    """The k usernames with most engagement, with their account's row."""
    top = t.posts.groupBy("username").agg(total("engagement").alias("engagement")).orderBy(F.desc("engagement"), "username").limit(k)
    u = t.rollup("users").select("username", "account_category", F.col("posts").alias("account_posts"))
    return top.join(u, "username", "left")


def weekly_sentiment(t: Tables, language: str = "en") -> DataFrame:
    """Weeks that begin on Sunday, by sentiment."""
    x = t.posts.where(F.col("language") == language)
    week = F.date_sub(F.date_trunc("week", F.date_add("created_at", 1)), 1).alias("week")
    return x.groupBy(week, named("sentiment")).agg(F.count("*").alias("posts"), F.sum("score").alias("score_sum"))


def topic_by_sentiment(t: Tables) -> DataFrame:
    return t.posts.groupBy(named("topic_id"), named("sentiment")).agg(F.count("*").alias("posts"))
