import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import engagement
from tidemark.operators import ingest, jobs, lake
from tidemark.schema import POSTS_DDL, RAW_COLUMNS
from tidemark.sources import readers, sinks

NOW = "2026-01-01"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "part10.csv").write_text('id,text,created_at\n9,"line one\nline two",2016-01-02\n')
    (tmp_path / "part2.jsonl").write_text('{"id": 1, "text": "a #Tag", "created_at": "2016-01-01", "likes": 3, "replies": 1, "retweets": 2, "user": {"screen_name": "bob", "followers_count": "10"}}\nnot json\n\n{"id": 1, "text": "again", "created_at": "2016-01-01"}\n')
    (tmp_path / "part1.json").write_text(json.dumps({"data": [{"id": "x", "text": "from a wrapper", "created_at": 1478606400, "hashtags": ["#One", "two"]}, {"text": "no id"}, 7]}))
    with gzip.open(tmp_path / "part3.csv.gz", "wt") as f:
        f.write("id,text,created_at\n5,zipped,2016-01-03\n6,,2016-01-03\n7,no date,never\n")
    (tmp_path / "notes.txt").write_text("not data")
    return str(tmp_path)


def test_formats_and_order(spark, folder):
    names = [p.rpartition("/")[2] for p in readers.expand_paths(spark, [folder])]
    assert names == ["part1.json", "part2.jsonl", "part3.csv.gz", "part10.csv"]
    with pytest.raises(readers.UnsupportedFormatError):
        readers.detect_format("a.txt")


def test_ingest(spark, folder):
    raw = readers.read(spark, [folder])
    posts = ingest.normalise(raw, "generic", now=NOW)
    assert {r["reason"]: r["n"] for r in ingest.reasons(posts).collect()} == {"parse_error": 2, "missing_id": 1, "empty_text": 1, "invalid_timestamp": 1}
    kept = {r["post_id"]: r for r in ingest.accepted(posts).collect()}
    assert set(kept) == {"x", "1", "5", "9"}
    assert kept["1"]["clean_text"] == "a Tag" and kept["1"]["engagement"].asDict() == {"likes": 3, "comments": 1, "shares": 2, "total": 6, "synthetic": False, "generator": None}
    assert kept["1"]["user"]["username"] == "bob" and kept["1"]["reach"] == 10
    assert kept["x"]["hashtags"] == ["one", "two"] and kept["9"]["clean_text"] == "line one line two"
    c = ingest.counters(posts).first()
    assert (c["read"], c["rejected"], c["accepted"], c["duplicates"]) == (10, 5, 4, 1)


def test_append_is_idempotent(spark, folder, tmp_path):
    posts = ingest.accepted(ingest.normalise(readers.read(spark, [folder]), now=NOW))
    to = str(tmp_path / "posts")
    assert sinks.append_new(posts, to).first()["inserted"] == 4
    again = sinks.append_new(posts, to).first()
    assert (again["inserted"], again["duplicates"]) == (0, 4)
    assert spark.read.parquet(to).count() == 4
    assert {f.split(":")[0].split()[0] for f in POSTS_DDL.strip().splitlines()[:1]} == {"post_id"}


def test_job(spark, tmp_path):
    """Ingest, append, enrich and refresh; a second job touches its days, the same job again changes nothing."""
    (tmp_path / "a.csv").write_text("id,text,created_at,language,author\n1,election election today #Vote,2016-01-01,English,ann\n2,выборы выборы сегодня,2016-01-02,Russian,bob\n3,,2016-01-02,English,bob\n")
    (tmp_path / "b.csv").write_text("id,text,created_at,language,author\n2,again,2016-01-02,English,bob\n4,another election,2016-01-02,English,ann\n")
    root = str(tmp_path / "lake")
    c = jobs.run(spark, [str(tmp_path / "a.csv")], root, "j1")
    assert (c["read"], c["rejected"], c["inserted"]) == (3, 1, 2)
    p = {r["post_id"]: r for r in jobs.posts(spark, root).collect()}
    assert all(r["processed"] for r in p.values()) and p["1"]["keywords"][0] == "election" and p["2"]["keywords"] is None
    cube = lambda: sorted((str(r["day"]), r["posts"]) for r in spark.read.parquet(f"{root}/rollups/daily_cube").groupBy("day").agg(F.sum("posts").alias("posts")).collect())
    assert cube() == [("2016-01-01", 1), ("2016-01-02", 1)]
    for inserted in (1, 0):
        c = jobs.run(spark, [str(tmp_path / "b.csv")], root, "j2")
        assert (c["inserted"], c["known"]) == (inserted, 2 - inserted)
        assert cube() == [("2016-01-01", 1), ("2016-01-02", 2)]
        users = {r["username"]: r["posts"] for r in spark.read.parquet(f"{root}/rollups/users").collect()}
        assert users == {"ann": 2, "bob": 1}


def test_lake(spark, tmp_path):
    rows = [["a1", "bob", "Hello #World", "United States", "English", f"{m}/1/2016 10:00", "", "1", "9", "2", kind, "", "1" if kind == "RETWEET" else "0", "Right", "", "77", str(i), "", "", "", ""] for i, (m, kind) in enumerate([(1, ""), (1, "RETWEET"), (2, "QUOTE_TWEET"), (2, ""), (3, "")])]
    rows.append([*rows[0]])  # the same id again
    rows.append([*rows[0][:5], "garbage", *rows[0][6:16], "99", "", "", "", ""])
    (tmp_path / "raw").mkdir()
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS)).coalesce(1).write.mode("overwrite").option("header", True).csv(str(tmp_path / "raw"))
    b = lake.build_bronze(spark, str(tmp_path / "raw"), str(tmp_path / "lake/bronze"))
    assert b.count() == 7
    assert {r["reason"]: r["n"] for r in lake.invalid_histogram(b).collect()} == {"valid": 6, "invalid_timestamp": 1}
    s = lake.build_silver(spark, b, str(tmp_path / "lake/silver"))
    assert s.count() == 5 and s.where("is_retweet").count() == 1 and s.where("post_type = 'quote'").count() == 1
    g = lake.build_gold(spark, s, str(tmp_path / "lake/gold"))
    assert g["top_hashtags"].first()["posts"] == 5 and g["monthly_category"].agg(F.sum("posts")).first()[0] == 5
    assert lake.summaries(g)["monthly_total"].count() == 3
    inv = {(r["layer"], r["table"]): r for r in lake.inventory(spark, str(tmp_path / "lake")).collect()}
    assert inv["silver", ""]["partitions"] == 3
    q = lake.layout_queries(readers.read_raw_csv(spark, str(tmp_path / "raw")), b, s, 2016, 1)
    assert {n: q["category_of_month"][n].agg(F.sum("count")).first()[0] for n in ("csv", "bronze", "silver")} == {"csv": 3, "bronze": 3, "silver": 2}
    assert "month" in lake.plan_of(q["category_of_month"]["silver"])["partition_filters"]


def test_lake_as_one_program(spark, tmp_path):
    rows = [["a1", "bob", f"Hello #T{i % 2}", "United States", "English", "1/1/2016 10:00", "", "1", "9", "2", "", "", "0", "Right", "", "77", str(i % 4), "", "", "", ""] for i in range(5)]
    rows.append([*rows[0][:2], " ", *rows[0][3:]])
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_COLUMNS)).coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    report = {r["step"]: r["rows"] for r in lake.run(spark, str(tmp_path / "raw"), str(tmp_path / "lake")).collect()}
    assert report == {"bronze": 6, "validation": 6, "silver": 4, "gold": 4, "rejected: empty_text": 1, "duplicates removed": 1}
    assert {r["hashtag"] for r in spark.read.parquet(str(tmp_path / "lake/gold/top_hashtags")).collect()} == {"t0", "t1"}


def test_sinks(spark, tmp_path):
    df = spark.range(30).withColumn("x", F.col("id") * 2)
    path = str(tmp_path / "t")
    sinks.rebuild(df, path)
    sinks.rebuild(df.where("id < 10"), path)
    assert spark.read.parquet(path).count() == 10 and not sinks.exists(spark, f"{path}.old") and not sinks.exists(spark, f"{path}.staging")
    for codec in ("none", "snappy", "gzip", "zstd", "json"):
        sinks.write_with_codec(df, str(tmp_path / codec), codec)
        assert (spark.read.json if codec == "json" else spark.read.parquet)(str(tmp_path / codec)).count() == 30
    assert sinks.extract(df.orderBy("id"), 2) == [{"id": 0, "x": 0}, {"id": 1, "x": 2}]
    out = str(tmp_path / "batches")
    sinks.in_batches(df.repartition(2), lambda rows: open(out, "a").write("".join(f"{r['id']}\n" for r in rows)), 4)
    assert sorted(map(int, open(out))) == list(range(30))


def test_samples(spark):
    df = spark.range(10_000)
    a, b = (readers.sample_share(df, 0.1, 7).count() for _ in range(2))
    assert a == b and 800 < a < 1200
    assert readers.sample_rows(df, 5).collect() == readers.sample_rows(df, 5).collect()
    low, high = lake.terciles(df, "id")
    assert abs(low - 3333) <= 12 and abs(high - 6667) <= 12


def test_synthetic_engagement(spark):
    n = engagement.generated(["12", "13"], np.array([5000.0, 0.0]), np.array([False, True]))
    a = n.iloc[0].tolist()
    assert a == engagement.generated(["12"], np.array([5000.0]), np.array([False])).iloc[0].tolist() and min(a) >= 0
    rows = spark.createDataFrame([("12", 5000, False, None), ("13", None, True, None)], "post_id string, reach bigint, is_retweet boolean, engagement struct<likes: bigint, comments: bigint, shares: bigint, total: bigint, synthetic: boolean, generator: string>")
    made = engagement.synthesize(rows)
    assert {r["post_id"]: r["engagement"]["likes"] for r in made.collect()} == {"12": a[0], "13": 0}
    assert engagement.remove(made).where("engagement is not null").count() == 0
