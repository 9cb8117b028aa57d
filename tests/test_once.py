"""What must be done once only: counters from one pass, rows sent once, streams that repeat or start again."""

import json
import os
import subprocess
import sys
import textwrap

from pyspark.sql import functions as F

from tidemark.fixtures import posts_fx
from tidemark.operators import ingest, jobs
from tidemark.operators import rollups as R
from tidemark.sources import batches, readers, sinks
from tidemark.streaming import refresh


def plans(spark):
    store, out = spark._jsparkSession.sharedState().statusStore(), {}
    runs = store.executionsList()
    for i in range(runs.size()):
        out[runs.apply(i).executionId()] = runs.apply(i).physicalPlanDescription()
    return out


def test_a_job_plans_its_input_once(spark, tmp_path):
    rows = [f"{i % 900},text {i % 7} #tag,2016-01-0{1 + i % 3},English,u{i % 11}" for i in range(1000)] + [f",no id {i},2016-01-01,English,x" for i in range(40)] + ["7,,2016-01-01,English,x", "8,text,never,English,x"]
    (tmp_path / "a.csv").write_text("id,text,created_at,language,author\n" + "\n".join(rows) + "\n")
    read = ingest.normalise(readers.read(spark, [str(tmp_path / "a.csv")]), job_id="j")
    before = set(plans(spark))
    counts = jobs.take(read, str(tmp_path / "posts"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    made = [p for i, p in plans(spark).items() if i not in before and "a.csv" in p]
    assert len(made) == 1 and made[0].split("Initial Plan")[0].count("Scan csv") == 1  # one write, one scan in it
    assert counts["read"] == 1042 and counts["rejected"] == 42 and counts["accepted"] == 900 and counts["duplicates"] == 100
    assert (counts["rejected_missing_id"], counts["rejected_empty_text"], counts["rejected_invalid_timestamp"]) == (40, 1, 1)
    assert (counts["inserted"], counts["known"], counts["schema_validation"], counts["with_hashtags"]) == (900, 0, 0, 900)
    assert spark.read.parquet(str(tmp_path / "posts")).count() == 900
    again = jobs.take(read, str(tmp_path / "posts"))
    assert (again["inserted"], again["known"], again["read"]) == (0, 900, 1042)
    own = ingest.counters(read).first().asDict()
    assert all(counts[k] == v for k, v in own.items())
    none = ingest.normalise(readers.read(spark, [str(tmp_path / "a.csv")]).limit(0))
    assert jobs.take(none, str(tmp_path / "posts"))["read"] == 0


def test_rows_are_sent_once_though_tasks_fail(tmp_path):
    """A session of its own: tasks run again only where a master allows failures."""
    out = str(tmp_path / "out")
    code = textwrap.dedent(f"""
        import os
        from tidemark.session import get_session
        from tidemark.sources import batches
        from pyspark import TaskContext

        class Failing(batches.Folder):
            def stage(self, rows):
                token = super().stage(rows)
                if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1 and any(r["id"] % 3 == 0 for r in rows):
                    raise OSError("after staging")
                return token

        s = get_session("once", spark__master="local[2,3]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
        s.sparkContext.setLogLevel("OFF")
        batches.send_once(s.range(100).repartition(3), Failing("file://{out}"), 7)
        s.stop()
    """)
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    sent = [f for f in os.listdir(out) if f.endswith(".jsonl")]
    lines = [json.loads(x)["id"] for f in sent for x in open(f"{out}/{f}")]
    assert sorted(lines) == list(range(100)) and all(sum(1 for _ in open(f"{out}/{f}")) <= 7 for f in sent)
    assert os.listdir(f"{out}/_staged")  # what the failed attempt staged was never published


def test_nothing_is_published_of_a_failed_write(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = spark.range(50).repartition(2).withColumn("x", F.when(F.col("id") == 49, F.raise_error(F.lit("bad row")).cast("int")).otherwise(1))
    try:
        batches.send_once(bad, batches.Folder(f"file://{out}"), 5)
        raise AssertionError("it should fail")
    except Exception as e:
        assert "bad row" in str(e)
    assert not [f for f in (os.listdir(out) if os.path.exists(out) else []) if f.endswith(".jsonl")]
    store = batches.Folder(f"file://{tmp_path}/twice")
    token = store.stage(spark.range(3).collect())
    store.publish([token]), store.publish([token]), store.discard([token])
    assert [f for f in os.listdir(tmp_path / "twice") if f.endswith(".jsonl")] == [token]


def test_ids_are_known_whatever_their_day(spark, sf_dir, tmp_path):
    posts = posts_fx(spark, sf_dir)
    src, table, root = (str(tmp_path / x) for x in ("in", "posts", "rollups"))
    old = posts.where("created_at < '2024-01-05'")
    old.write.parquet(table)
    R.rebuild(spark.read.parquet(table), root)
    n = old.count()
    moved = old.limit(5).withColumn("created_at", F.expr("created_at + interval 9 days"))  # the same ids with another time
    new = posts.where("created_at >= '2024-01-20' and created_at < '2024-01-21'")
    new.unionByName(new).unionByName(moved).coalesce(1).write.parquet(src)
    refresh.keep_fresh(spark.readStream.schema(posts.schema).parquet(src), table, root, str(tmp_path / "cp")).awaitTermination()
    t = spark.read.parquet(table)
    assert t.count() == t.select("post_id").distinct().count() == n + new.count()
    assert spark.read.parquet(f"{root}/hourly_cube").agg(F.sum("posts")).first()[0] == t.count()
    batch = sinks.append_unknown(moved, table)
    assert (batch["inserted"], batch["known"]) == (0, 5)


def test_hours_with_late_repeated_and_replayed_batches(spark, tmp_path):
    kind = "post_id string, created_at timestamp_ntz, language string, sentiment string, reach bigint, engagement bigint"
    post = lambda i, at: (f"p{i}", at, "en", None, i, 1)
    src, out, cp = (str(tmp_path / x) for x in ("in", "hours", "cp"))

    def arrive(name, rows):
        cols = kind.replace("timestamp_ntz", "string")
        df = spark.createDataFrame(rows, cols).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(src)
        refresh.write_hours(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), out, cp, "1 day").awaitTermination()

    first = [post(i, f"2024-01-01 {i % 24:02}:10:00") for i in range(60)]
    second = [post(100 + i, f"2024-01-02 {i % 12:02}:20:00") for i in range(30)]
    arrive("a", first + first[:10])  # repeated in the batch
    arrive("b", second + first[40:])  # and in the next one; the query starts again from its checkpoint
    arrive("c", [post(500, "2024-01-05 00:00:00")])
    arrive("d", [post(600, "2024-01-01 03:00:00"), post(501, "2024-01-05 01:00:00")])  # far too late
    refresh.write_hours(spark.readStream.schema(kind).parquet(src), out, cp, "1 day").awaitTermination()  # nothing new
    arrive("e", [post(700, "2024-02-01 00:00:00")])
    arrive("f", [post(701, "2024-02-02 12:00:00")])
    got = sorted((str(r["hour"])[:13], r["posts"], r["reach"]) for r in spark.read.parquet(out).collect())
    kept = [*first, *second, post(500, "2024-01-05 00:00:00"), post(501, "2024-01-05 01:00:00")]
    hours = {}
    for p in kept:
        n, reach = hours.get(p[1][:13], (0, 0))
        hours[p[1][:13]] = (n + 1, reach + p[4])
    want = sorted((h, *v) for h, v in hours.items())
    assert [g for g in got if not g[0].startswith("2024-02")] == want
