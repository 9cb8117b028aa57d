"""What is built once and read from then on: published rollups, the search index, bloom filters, sketches."""

import os
import random
import shutil
import time
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.fixtures import posts_fx
from tidemark.operators import analytics as A
from tidemark.operators import indexes, search
from tidemark.operators import rollups as R
from tidemark.plans.filters import Filters
from tidemark.plans.planner import Tables


def files_of(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root.removeprefix("file://")) for f in names}


def test_published_once_and_never_touched(spark, sf_dir):
    a = catalog.QUERIES["q4_sentiment_dist_cube"](spark, sf_dir)
    b = catalog.QUERIES["q4_sentiment_by_country_cube"](spark, sf_dir)
    root = catalog.tables(spark, sf_dir).root
    before = files_of(f"{root}/daily_cube")
    c = catalog.QUERIES["q4_sentiment_dist_cube"](spark, sf_dir)
    assert a.count() == c.count() > 0 and b.count() > 0 and a.count() > 0
    assert files_of(f"{root}/daily_cube") == before
    # another object with the same root finds what is there
    again = Tables(posts_fx(spark, sf_dir), root=root)
    assert again.rollup("daily_cube").inputFiles() == catalog.tables(spark, sf_dir).rollup("daily_cube").inputFiles()
    assert files_of(f"{root}/daily_cube") == before


def test_changed_input_is_noticed(spark, sf_dir, tmp_path):
    for name in catalog.SOURCES:
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    held = catalog.QUERIES["q9_engagement_totals_cube"](spark, str(tmp_path))
    first, root = held.first(), catalog.tables(spark, str(tmp_path)).root
    time.sleep(0.01)
    spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 500").toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    now = catalog.QUERIES["q9_engagement_totals_cube"](spark, str(tmp_path)).first()
    assert catalog.tables(spark, str(tmp_path)).root != root
    assert now["posts"] < first["posts"] and held.first() == first


# -- search

TEXTS = ["The quick brown fox", "quick, QUICK! brown-fox the the", "", None, "brown quick fox", "naïve Öl straße 中文 字 x_y 12", "the_quick brown  fox\n\nthe", "fox " * 500 + "quick brown", "the"]


@pytest.fixture(scope="module")
def odd_posts(spark):
    rows = [(f"p{i:03}", f"2024-01-{1 + i % 5:02} 10:00:00", TEXTS[i % len(TEXTS)]) for i in range(45)]
    return spark.createDataFrame(rows, "post_id string, at string, clean_text string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))


def test_queries_are_read(spark):
    assert search.parse('Fox "The QUICK, brown" -the -"brown fox" x-y') == search.Asked(("brown", "fox", "quick", "the", "x", "y"), (("the", "quick", "brown"),), (("the",), ("brown", "fox")))
    assert search.parse('-only "" - "') == search.Asked((), (), (("only",),))


def test_index_finds_what_patterns_find(spark, odd_posts):
    index = search.postings(odd_posts).cache()
    said = ["quick", "brown", "fox", "the", "x_y", "öl", "中文", "12", "nowhere"]
    rng, asked = random.Random(3), ['"quick brown"', 'fox -"brown fox"', "-the", '"the the" -quick', '"fox fox" 中文', "", "nowhere", "NAÏVE"]
    for _ in range(12):
        q = []
        for _ in range(rng.randrange(1, 4)):
            few = rng.sample(said, rng.randrange(1, 3))
            q.append(rng.choice(["", "", "-"]) + (f'"{" ".join(few)}"' if len(few) > 1 else few[0]))
        asked.append(" ".join(q))
    for q in asked:
        want = {(r["post_id"], r["n"]) for r in odd_posts.select("post_id", search.hits(F.col("clean_text"), q).alias("n")).where("n > 0").collect()}
        got = {(r["post_id"], r["relevance"]) for r in search.found(index, q).collect()}
        assert got == want, q
    span = {r["post_id"] for r in search.found(index, "fox", date(2024, 1, 2), date(2024, 1, 3)).collect()}
    assert span == {r["post_id"] for r in odd_posts.where("clean_text rlike '(?i)fox' and day(created_at) in (2, 3)").collect()}
    assert search.ranked(index, search.text_daily(odd_posts), "", 5).count() == 0
    assert index.where("word = 'fox' and tf = 500").count() == 5
    index.unpersist()


def test_search_reads_only_asked_buckets(spark, sf_dir):
    t = catalog.tables(spark, sf_dir)
    df = search.found(t.rollup("postings"), "una atst", date(2024, 1, 5), date(2024, 1, 9))
    plan = df._jdf.queryExecution().executedPlan().toString()
    asked = {r["b"] for r in spark.createDataFrame([("una",), ("atst",)], "w string").select(search._bucket(F.col("w")).alias("b")).collect()}
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(word, [atst,una])" in plan and "positions" not in plan.split("ReadSchema")[1]
    seen = indexes.scan(df)
    there = t.rollup("postings").where(F.col("bucket").isin(list(asked)) & F.col("day").between("2024-01-05", "2024-01-09")).count()
    assert 0 < seen.rows <= there < seen.rows_there / 4
    page = A.list_posts(t, Filters(q="una atst"), "newest", 1, 10)
    read = page._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket#" in read and "text:string" not in read.split("Physical Plan")[1]  # no text is read


def test_refreshed_day_equals_rebuilt(spark, odd_posts, tmp_path):
    posts = odd_posts.withColumns({c: F.lit(None).cast(k) for c, k in {"language": "string", "country": "string", "sentiment": "string", "topic_id": "string", "score": "double", "likes": "bigint", "comments": "bigint", "shares": "bigint", "account_category": "string", "account_type": "string", "reach": "bigint", "followers": "bigint"}.items()})
    posts = posts.withColumns({"username": F.col("post_id"), "user_id": F.col("post_id"), "hashtags": F.array(F.lit("a")), "keywords": F.array(F.lit("b")), "is_retweet": F.lit(False), "processed": F.lit(True), "engagement": F.length("clean_text").cast("bigint"), "engagement_synthetic": F.lit(False)})
    root = str(tmp_path / "r")
    R.rebuild(posts, root)
    now = posts.where("post_id <> 'p007' and day(created_at) <> 4").withColumn("clean_text", F.when(F.day("created_at") == 2, "new words").otherwise(F.col("clean_text")))
    R.refresh_days(now, root, [date(2024, 1, 2), date(2024, 1, 3), date(2024, 1, 4)])
    for name, keys in {"postings": ["day", "bucket", "word", "post_id", "tf", "length", "positions"], "text_daily": ["day", "texts", "words"], "engagement_daily": ["day", "language", "posts"], "daily_cube": ["day", "language", "posts", "engagement"], "hashtag_daily": ["day", "hashtag", "posts"]}.items():
        rows = lambda df, k=keys: sorted(map(repr, df.select(k).collect()))
        assert rows(spark.read.parquet(f"{root}/{name}")) == rows(R.BUILDERS[name](now)), name
    assert not [d for d in os.listdir(f"{root}/postings") if "2024-01-04" in d] and not [d for d in os.listdir(root) if "refresh" in d]


# -- lookups


def test_lookup_skips_row_groups(spark, sf_dir, tmp_path):
    posts = posts_fx(spark, sf_dir).withColumn("post_id", F.sha2("post_id", 256)).withColumn("text_hash", F.sha2("post_id", 224))
    r = posts.select("post_id", "text_hash").first()
    for bloom in (True, False):
        path = str(tmp_path / f"bloom-{bloom}")
        indexes.write(posts, path, rows=20, bloom=bloom)
        t = spark.read.parquet(path)
        for q in (indexes.one(t, r["post_id"]), indexes.same_text(t, r["text_hash"])):
            seen = indexes.scan(q.select("username", "created_at"))
            assert seen.rows_there == 1000 and (seen.skipped > 0.9) == bloom
    days = indexes.within(spark.read.parquet(path), "2024-01-08 00:00:00", "2024-01-10 00:00:00")
    assert indexes.scan(days.select("username")).skipped > 0.8 and days.count() == posts.where("to_date(created_at) in ('2024-01-08', '2024-01-09')").count()
    assert indexes.scan(indexes.one(t, "nobody").select("username")).rows <= 1000


def test_get_post(spark, sf_dir):
    t = catalog.tables(spark, sf_dir)
    assert A.get_post(t, "no such post").count() == 0
    own, plain = (A.get_post(x, "5").select("post_id", "identical_texts").first() for x in (t, Tables(t.posts)))
    assert own == plain and own["identical_texts"] >= 1


# -- sketches


def test_accounts_united_over_spans(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2024-01-{1 + int(d):02}", f"u{int(u)}") for d, u in zip(rng.integers(0, 28, 60_000), rng.zipf(1.3, 60_000) % 30_000, strict=True)]
    x = spark.createDataFrame(rows, "day string, user string")
    daily = x.groupBy("day").agg(F.hll_sketch_agg("user", R.ACCOUNT_REGISTERS).alias("s"))
    for least in (1, 10, 20, 28):
        days = f"day >= '2024-01-{least:02}'"
        exact = x.where(days).agg(F.count_distinct("user")).first()[0]
        about = daily.where(days).agg(F.hll_sketch_estimate(F.hll_union_agg("s"))).first()[0]
        assert abs(about - exact) <= 0.05 * exact


def test_quantiles_united_over_spans(spark):
    rng = np.random.default_rng(2)
    values = [*rng.integers(0, 50, 20_000).tolist(), *np.exp(rng.normal(8, 2, 40_000)).astype(int).tolist()]
    x = spark.createDataFrame([(i % 40, v) for i, v in enumerate(values)], "cell int, v bigint")
    cells = x.groupBy("cell").agg(F.kll_sketch_agg_bigint("v", F.lit(R.QUANTILE_K)).alias("s"))
    merged = cells.agg(F.kll_merge_agg_bigint("s", F.lit(R.QUANTILE_K)).alias("s"))
    shares = (0.01, 1 / 3, 0.5, 2 / 3, 0.99)
    got = merged.select(*[F.kll_sketch_get_quantile_bigint("s", F.lit(q)).alias(f"q{i}") for i, q in enumerate(shares)]).first()
    v = np.sort(values)
    for q, g in zip(shares, got, strict=True):
        assert np.searchsorted(v, g) / len(v) - 0.01 <= q <= np.searchsorted(v, g, "right") / len(v) + 0.01


def test_sketches_and_rows_agree_for_any_filter(spark, sf_dir):
    t = catalog.tables(spark, sf_dir)
    few = A.engagement_quantiles(t, (0.5,), Filters(country="Unknown", start=date(2024, 1, 3))).first()
    exact = t.posts.where("country is null and created_at >= '2024-01-03' and engagement is not null")
    assert few["posts"] == exact.count()
    assert {r["t"] for r in A.active_accounts(t, Filters(exclude_retweets=True)).collect()} >= {r["t"] for r in A.active_accounts(t).collect()}
    cube, live = (A.active_accounts(Tables(t.posts.where("processed"), built=t.built), Filters(mode=m)).orderBy("t").collect() for m in ("cube", "live"))
    assert [r["t"] for r in cube] == [r["t"] for r in live]
    assert all(abs(a["active_accounts"] - b["active_accounts"]) <= 0.05 * b["active_accounts"] for a, b in zip(cube, live, strict=True))


# -- texts that posts repeat


@pytest.fixture(scope="module")
def repeated(spark, odd_posts, tmp_path_factory):
    """Tables of posts that repeat texts, by post and by text."""
    hashed = odd_posts.withColumn("text_hash", F.sha2("clean_text", 256))
    posts = hashed.withColumns({c: F.lit(None).cast("string") for c in ("username", "language", "country", "sentiment", "topic_id")}).withColumns({"engagement": F.lit(1), "is_retweet": F.lit(False)})
    root = "file://" + str(tmp_path_factory.mktemp("texts"))
    return Tables(posts, root=root + "/by-post"), Tables(posts, root=root + "/by-text", texts=posts.select("text_hash", "clean_text"))


def test_each_text_is_indexed_once(spark, repeated):
    by_post, by_text = repeated
    assert by_text.stored_texts().count() == len({t for t in TEXTS if t is not None})
    words = {"fox", "quick", "the", "x_y"}
    want = sum(len({w for w in words if w in search._split(t.lower())}) for t in {t for t in TEXTS if t})
    assert by_text.text_postings().where(F.col("word").isin(list(words))).count() == want
    assert "clean_text" not in by_text.by_time().columns and by_text.by_time().count() == 45
    r = A.get_post(by_text, "p001").first()
    assert r["clean_text"] == TEXTS[1] and r["identical_texts"] == 5 and A.get_post(by_text, "p003").first()["clean_text"] is None


def test_index_by_text_finds_what_the_one_by_post_finds(spark, repeated):
    by_post, by_text = repeated
    for q in ("fox", '"quick brown"', 'fox -"brown fox"', "the -quick", '"the the" -x_y', "-the", "nowhere", "Öl 12"):
        for f in (Filters(q=q), Filters(q=q, start=date(2024, 1, 2), end=date(2024, 1, 4))):
            for sort in ("relevance", "oldest", "engagement"):
                a, b = ([(r["post_id"], r["relevance"]) for r in A.list_posts(t, f, sort, 1, 50).collect()] for t in repeated)
                assert a == b, (f, sort)
            assert A.count_posts(by_post, f).first() == A.count_posts(by_text, f).first()
            a, b = ([tuple(r) for r in A.best_posts(t, q, 20, f.start, f.end).collect()] for t in repeated)
            assert a == b, f
